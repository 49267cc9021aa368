"""Near copies: texts that share at least four fifths of their five-word shingles, for the pipeline.

Candidates come from op3's fingerprints, those within two bits (``simhash``), and from min-hashes: BANDS tables, each keyed by the smallest values of ROWS hash functions over a
text's shingles. A pair just at the threshold meets in no table with a chance of (1 - 0.8^4)^32, 5e-8; closer
pairs are missed more rarely still. A candidate is a link only if the exact similarity of the shingle sets,
worked out again from the texts, is 0.8 or more; that alone decides.

Texts of equal words are one node. Each bucket first meets its hub, the member with the most company in all
tables. What the hub links needs no more comparison among itself. The others of the bucket meet each other and
the hub's part in chunks, two by two, so that no task holds more than two chunks and a meeting gives a
spanning forest of its links, never all pairs. Buckets of the same members are compared once.

Cases: null and blank texts have no shingles and are copies of each other. A text of one to four words is one
shingle. Repeated rows are one node. A null doc_id comes after all others. Very long texts are read whole. An
empty table gives an empty result. Only doc_id and text are read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidmatrix.llm import simhash
from bidmatrix.llm.common import ship, text_bytes
from bidmatrix.llm.components import connected_components
from bidmatrix.session import stored

SHINGLE = 5
#: The threshold, 4/5, as whole numbers.
LIKE = (4, 5)
BANDS, ROWS = 32, 4
#: Nodes of one chunk of a bucket, about.
CHUNK = 64
SEED = 42

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.random.default_rng(SEED).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    wide = min(SHINGLE, len(words))
    out = np.full(len(words) - wide + 1, wide, np.uint64)
    for j in range(wide):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)])
    return np.unique(out)


def band_keys(found: np.ndarray) -> list[int]:
    """A key for each table; none without shingles."""
    if not len(found):
        return []
    least = np.full(len(_ODD), 2**64 - 1, np.uint64)
    for at in range(0, len(found), 1 << 10):
        some = found[at : at + (1 << 10), None] * _ODD
        least = np.minimum(least, some.min(axis=0))
    least = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, j])
    return keys.view(np.int64).tolist()


def alike(common: int, one: int, other: int) -> bool:
    """Whether sets of these sizes, and so many in common, reach the threshold."""
    return common * LIKE[1] >= (one + other - common) * LIKE[0]


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), node (hash of its words), keys, fp (op3's fingerprint) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            view, nodes, keys, prints = memoryview(data), [], [], []
            for a, b in zip(starts[:-1], starts[1:]):
                text = bytes(view[a:b])
                words = words_of(text)
                digest = xxhash.xxh64_intdigest(b" ".join(words), SEED)
                nodes.append(digest - (1 << 64) if digest >> 63 else digest)
                keys.append(band_keys(shingles(words)))
                digest = simhash.fingerprint(text)
                prints.append(digest - (1 << 64) if digest >> 63 else digest)
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "node", "keys", "fp"])

    chosen = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id bigint, mark bigint, node bigint, keys array<bigint>, fp bigint")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles (their hashes' bytes) of the wanted nodes, given as node and mark."""
    texts = docs.select(F.xxhash64("text").alias("mark"), F.col("text").cast("string")).join(wanted, "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            view = memoryview(data)
            found = [shingles(words_of(bytes(view[a:b]))).tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "shingles"])

    return texts.dropDuplicates(["mark"]).select("node", "text").mapInArrow(run, "node bigint, shingles binary")


def _numbers(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint64)


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (one, other) that reach the threshold."""
    side = lambda name, held: sets.select(F.col("node").alias(name), F.col("shingles").alias(held))
    both = pairs.join(side("one", "mine"), "one").join(side("other", "theirs"), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for mine, theirs in zip(batch.column("mine").to_pylist(), batch.column("theirs").to_pylist()):
                a, b = _numbers(mine), _numbers(theirs)
                kept.append(alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
            yield batch.select(["one", "other"]).filter(pa.array(kept, pa.bool_()))

    return both.select("one", "other", "mine", "theirs").mapInArrow(run, "one bigint, other bigint")


def forest(mine: list[dict], theirs: list[dict]) -> list[tuple[int, int]]:
    """Links between two chunks, or inside one, that join components not yet joined."""
    rows = {r["node"]: r for r in [*mine, *theirs]}
    order = list(rows)
    if len({r["part"] for r in rows.values()}) < 2:
        return []
    sets = [_numbers(rows[k]["shingles"]) for k in order]
    sizes = np.array([len(s) for s in sets])
    values, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    columns = np.where(shared[columns], (np.cumsum(shared) - 1)[columns], -1)
    owners = np.repeat(np.arange(len(order)), sizes)
    common = np.zeros((len(order), len(order)))
    for at in range(0, int(shared.sum()), 1 << 14):
        inside = (columns >= at) & (columns < at + (1 << 14))
        held = np.zeros((len(order), 1 << 14), np.float32)
        held[owners[inside], columns[inside] - at] = 1
        common += held @ held.T
    common = common.astype(np.int64)

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    near = np.triu(common * LIKE[1] >= (sizes[:, None] + sizes[None, :] - common) * LIKE[0], 1)
    out = []
    for i, j in np.argwhere(near).tolist():
        a, b = find(rows[order[i]]["part"]), find(rows[order[j]]["part"])
        if a != b:
            root[b] = a
            out.append((order[i], order[j]))
    return out


def linked_chunks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """one, other: links that join parts, from members of buckets with key, node, part, main (in the hub's part)."""
    sizes = stored(members.groupBy("key", "main").agg(F.count(F.lit(1)).alias("n")))
    dealt = members.join(sizes, ["key", "main"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK)))
    held = dealt.join(sets, "node").groupBy("key", "main", "chunk").agg(
        F.collect_list(F.struct("node", "part", "shingles")).alias("held")
    )
    held = stored(held)
    mine = held.where("not main").select("key", F.col("chunk").alias("i"), F.col("held").alias("mine"))
    theirs = held.select("key", "main", F.col("chunk").alias("j"), F.col("held").alias("theirs"))
    met = mine.join(theirs, "key").where(F.col("main") | (F.col("j") >= F.col("i"))).select("mine", "theirs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = forest(batch.column("mine")[at].as_py(), batch.column("theirs")[at].as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["one", "other"])

    return met.mapInArrow(run, "one bigint, other bigint")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """one, other: nodes with the first node of their fingerprint, and first nodes of fingerprints that op3 links."""
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.join(first, "fp").where("node <> first").select(F.col("node").alias("one"), F.col("first").alias("other"))
    near = simhash.links(first.select("fp")).join(first.withColumnRenamed("first", "one"), "fp")
    near = near.join(first.select(F.col("fp").alias("near"), F.col("first").alias("other")), "near")
    return equal.unionByName(near.select("one", "other"))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """one, other: pairs of nodes that reach the threshold, enough of them to connect all that do."""
    tables = nodes.select("node", F.explode("keys").alias("key"))
    sizes = stored(tables.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = stored(tables.join(sizes, "key"))
    company = stored(met.groupBy("node").agg(F.sum("n").alias("company")))
    hubs = met.join(company, "node").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("same"),
        F.max(F.struct("company", "node")).alias("hub"),
    )
    # tables often bring the same nodes together again
    hubs = stored(hubs.groupBy("n", "same", "hub.node").agg(F.min("key").alias("key"))).select("key", F.col("node").alias("hub"))
    members = stored(met.select("key", "node").join(hubs, "key"))
    close = stored(fingerprint_pairs(nodes))
    met_nodes = company.select("node").union(close.select("one")).union(close.select("other")).distinct()
    wanted = stored(nodes.select("node", "mark").join(met_nodes, "node", "left_semi"))
    sets = stored(shingle_sets(docs, wanted))

    pairs = members.where("node <> hub").select(F.col("node").alias("one"), F.col("hub").alias("other")).unionByName(close).distinct()
    first = stored(linked_pairs(pairs, sets))
    parts = stored(connected_components(first, "one", "other"))
    part = lambda of: parts.select(F.col("node").alias(of), F.col("component").alias(f"{of}_part"))
    placed = members.join(part("node"), "node", "left").join(part("hub"), "hub", "left").select(
        "key", "node", F.coalesce("node_part", "node").alias("part"),
        (F.coalesce("node_part", "node") == F.coalesce("hub_part", "hub")).alias("main"),
    )
    placed = stored(placed)
    # a bucket of two has met; one that its hub holds together needs no more
    open_ones = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("main")).alias("apart"))
    open_ones = stored(open_ones.where("n > 2 and apart > 0").select("key"))
    second = linked_chunks(stored(placed.join(open_ones, "key", "left_semi")), sets)
    return first.unionByName(second).distinct()


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as doc_id, mark, node; and nodes as node, component, least (no_id, doc_id, mark of the node's first row)."""
    found = stored(prints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("least")
    nodes = stored(found.groupBy("node").agg(first, F.min("mark").alias("mark"), F.min("keys").alias("keys"), F.min("fp").alias("fp")))
    linked = connected_components(links(docs, nodes), "one", "other")
    placed = nodes.select("node", "least").join(linked, "node", "left")
    return found.select("doc_id", "mark", "node"), placed.withColumn("component", F.coalesce("component", "node"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each group the row with the smallest doc_id, then hash of its text, with its columns.

    The rows meet the kept ones and lose repeated rows in one shuffle, by a key that stands for a null doc_id too.
    """
    _, placed = groups(docs)
    key = lambda doc_id: F.coalesce(doc_id.cast("bigint"), F.lit(-(2**63)))
    kept = placed.groupBy("component").agg(F.min("least").alias("least"))
    kept = stored(kept.select(key(F.col("least.doc_id")).alias("copy_key"), F.col("least.mark").alias("copy_text")).distinct())
    rows = docs.withColumn("copy_key", key(F.col("doc_id"))).withColumn("copy_text", F.xxhash64("text"))
    rows = rows.join(kept, ["copy_key", "copy_text"], "left_semi").dropDuplicates(["copy_key", "copy_text"])
    return rows.select(*docs.columns)

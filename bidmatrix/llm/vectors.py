"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

A unit vector is rotated by random orthogonal matrices and coded by the signs of its coordinates. With the
code's own product with its vector kept as correction factor, the product of a code with another rotated
vector, divided by the factor, estimates the two vectors' cosine without bias, and the factor gives the
spread. A pair whose estimate stays below the threshold by more than `sure` standard errors is dropped;
every other pair is computed again in double precision, and that alone decides.

Pairs meet in tables keyed by `bits` of the signs. At the threshold two vectors differ in a share
angle/pi of the signs, so the number of tables follows from the wanted recall, and the bits from the number
of vectors, so that buckets of unrelated vectors stay small at every size. Equal vectors are one class. A
bucket with more than CHUNK classes is cut into chunks that meet two by two, so no task holds more than two
chunks. A pair counts in the first table where it meets. Only counts per class and a spanning forest of
each meeting leave a task, never all pairs.

Cases: vectors that are null, empty, all zero, or hold null or non-finite components link with nothing, nor
do vectors of different lengths. Repeated rows are equal vectors: each links the others. A null vec_id takes
part but names no component unless all in it are null. An empty table gives an empty result. Other columns
are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidmatrix.llm.common import ship
from bidmatrix.llm.components import connected_components
from bidmatrix.session import stored

#: Classes of one chunk of a bucket.
CHUNK = 512


@dataclass(frozen=True)
class Search:
    threshold: float = 0.95
    recall: float = 0.98  # of pairs just at the threshold; closer ones are found more surely
    per_bucket: int = 8  # unrelated classes in a bucket, about
    sure: float = 5.0  # standard errors
    seed: int = 11

    def shape(self, n: int) -> tuple[int, int]:
        """Bits per key and tables, for n classes."""
        bits = min(60, max(4, ceil(log2(max(2, n) / self.per_bucket))))
        meet = (1 - acos(self.threshold) / pi) ** bits
        return bits, max(1, ceil(log(1 - self.recall) / log(1 - meet)))


@lru_cache(maxsize=8)
def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """count random orthogonal matrices, side by side: (dim, count * dim)."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)], axis=1)


@lru_cache(maxsize=8)
def key_bits(dim: int, count: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """Which signs make up each table's key: (tables, bits), no sign twice while there are enough."""
    rng = np.random.default_rng([seed, dim, 1])
    return np.resize(rng.permutation(dim * count), tables * bits).reshape(tables, bits)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def code(units: np.ndarray, bits: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs (n, all), correction factors of the first rotation (n,), and keys (n, tables)."""
    dim = units.shape[1]
    count = ceil(bits * tables / dim)
    rotated = units @ rotations(dim, count, seed)
    signs = rotated > 0
    factors = np.abs(rotated[:, :dim]).sum(axis=1) / dim**0.5
    chosen = signs[:, key_bits(dim, count, bits, tables, seed)].astype(np.int64)
    return signs, factors, chosen @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def estimates(signs: np.ndarray, factors: np.ndarray, units: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased cosines of coded vectors (rows) with units (columns), and the rows' standard errors for orthogonal ones."""
    dim = units.shape[1]
    rotated = units @ rotations(dim, 1, seed)
    codes = np.where(signs[:, :dim], 1.0, -1.0) / (dim**0.5 * factors[:, None])
    spread = np.sqrt(np.maximum(1 / factors**2 - 1, 0) / max(1, dim - 1))
    return codes @ rotated.T, spread


def pairs_of(rows: dict[str, np.ndarray], table: int, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of one meeting that link and first meet in this table."""
    units = rows["unit"]
    found, spread = estimates(rows["signs"], rows["factor"], units, search.seed)
    slack = search.sure * spread * (1 - search.threshold**2) ** 0.5 + 1e-9
    a, b = np.nonzero(np.triu(found >= search.threshold - slack[:, None], 1))
    if rows["cross"]:  # two chunks: only pairs between them
        apart = rows["chunk"][a] != rows["chunk"][b]
        a, b = a[apart], b[apart]
    exact = np.einsum("ij,ij->i", units[a], units[b]) >= search.threshold
    a, b = a[exact], b[exact]
    first = (rows["keys"][a] == rows["keys"][b]).argmax(axis=1) == table
    return a[first], b[first]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that it reaches by the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


CODED = "class bigint, copies bigint, vector binary, code binary, factor double, keys array<bigint>"
FOUND = "class bigint, other bigint, n bigint"


def coded(classes: DataFrame, shape: tuple[int, int], kind: str, search: Search) -> DataFrame:
    """CODED rows of classes (class, copies, embedding); vectors keep the precision they came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("embedding")
            lengths = given.value_lengths().to_numpy(zero_copy_only=False)
            flat = given.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                vectors = flat[starts[rows][:, None] + np.arange(dim)]
                signs, factors, keys = code(unit(vectors.astype(np.float64)), *shape, search.seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("class").take(pa.array(rows)), batch.column("copies").take(pa.array(rows)),
                        pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary()),
                        pa.array([s.tobytes() for s in np.packbits(signs, axis=1)], pa.binary()),
                        pa.array(factors), pa.array(list(keys), pa.list_(pa.int64())),
                    ],
                    names=["class", "copies", "vector", "code", "factor", "keys"],
                )

    return classes.mapInArrow(run, CODED)


def meetings(members: DataFrame, kind: str, search: Search) -> DataFrame:
    """FOUND rows: other null and n links of a class, or a link of a spanning forest and n 0."""
    ordered = members.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def solve(batch: pa.Table) -> pa.RecordBatch:
        table, cross = batch.column("t")[0].as_py(), batch.column("i")[0].as_py() != batch.column("j")[0].as_py()
        vectors = batch.column("vector").to_pylist()
        classes, copies = batch.column("class").to_numpy(), batch.column("copies").to_numpy()
        lengths = np.array([len(v) for v in vectors])
        names, others, counts = [], [], []
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            if len(at) < 2:
                continue
            raw = np.frombuffer(b"".join(vectors[k] for k in at), dtype=kind).reshape(len(at), -1).astype(np.float64)
            packed = batch.column("code").take(pa.array(at)).to_pylist()
            signs = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(at), -1), axis=1)
            rows = {
                "unit": unit(raw), "signs": signs.astype(bool), "factor": batch.column("factor").to_numpy()[at],
                "keys": np.array(batch.column("keys").take(pa.array(at)).to_pylist()),
                "chunk": batch.column("chunk").to_numpy()[at], "cross": cross,
            }
            a, b = pairs_of(rows, table, search)
            if not len(a):
                continue
            own, many = classes[at], copies[at]
            n = np.bincount(a, many[b], len(at)) + np.bincount(b, many[a], len(at))
            root = forest(len(at), a, b)
            some, tied = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(at)))
            names += [own[some], own[tied]]
            others += [np.full(len(some), -1), own[root[tied]]]
            counts += [n[some].astype(np.int64), np.zeros(len(tied), np.int64)]
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (names, others, counts)]
        other = pa.array(joined[1].astype(np.int64), mask=joined[1] < 0)
        return pa.RecordBatch.from_arrays([pa.array(joined[0].astype(np.int64)), other, pa.array(joined[2].astype(np.int64))], names=["class", "other", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows = None  # the last group may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if open_rows is not None:
                table = pa.concat_tables([open_rows, table])
            marks = [table.column(c).to_numpy() for c in ("t", "key", "i", "j")]
            new = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            edges = [0, *new.tolist()]
            for start, stop in zip(edges[:-1], edges[1:]):
                if stop - start > 1:
                    yield solve(table.slice(start, stop - start).combine_chunks())
            open_rows = table.slice(edges[-1]).combine_chunks()
        if open_rows is not None and open_rows.num_rows > 1:
            yield solve(open_rows)

    return ordered.mapInArrow(run, FOUND)


def near_duplicates(rows: DataFrame, search: Search = Search()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vec_id and embedding."""
    ship(rows.sparkSession)
    element = rows.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    vector = F.col("embedding") if element in ("float", "double") else F.col("embedding").cast("array<double>")
    given = rows.select(F.col("vec_id").cast("bigint"), vector.alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))

    grouped = given.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stored(grouped.withColumn("class", F.monotonically_increasing_id()))
    shape = search.shape(classes.count())
    codes = stored(coded(classes.select("class", "copies", "embedding"), shape, kind, search))

    placed = codes.select("class", F.posexplode("keys").alias("t", "key"))
    sizes = placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = placed.join(stored(sizes), ["t", "key"])
    chunks = F.ceil(F.col("size") / CHUNK)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("class"), chunks))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("with")
    placed = placed.select("class", "t", "key", "chunk", others)
    placed = placed.select("class", "t", "key", "chunk", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"))
    found = stored(meetings(stored(placed).join(codes, "class"), kind, search))

    counts = found.where(F.col("other").isNull()).groupBy("class").agg(F.sum("n").alias("n"))
    linked = connected_components(found.where(F.col("other").isNotNull()), "class", "other")
    whole = (
        classes.join(counts, "class", "left")
        .join(linked.withColumnRenamed("node", "class"), "class", "left")
        .select(
            "embedding", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "class").alias("component"),
        )
    )
    whole = stored(whole)
    named = stored(whole.groupBy("component").agg(F.min("least").alias("component_id")))
    known = stored(whole.join(named, "component").select(F.col("embedding").alias("own"), "n_links", "component_id"))
    joined = given.join(known, F.when(usable, F.col("embedding")) == F.col("own"), "left")
    component = F.when(F.col("own").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's 64-bit fingerprint is the majority of the bits of its 3-word shingles' XXH64. Fingerprints link
when at most two bits differ. Bit i belongs to one of seven classes, the non-zero vectors of three bits;
mask v keeps the bits whose class has an odd product with v. Two differing bits span at most a plane, so
some of the seven v is orthogonal to both: that mask keeps neither bit, and the pair falls into the same
bucket of that table. No link is missed, and a bucket agrees in 36 or 37 bits, so few others are met.

Equal fingerprints are one node. In buckets of up to BUCKET nodes all pairs are compared. In larger ones,
every node instead names itself and its 64 one-bit neighbours: two nodes at distance two or less name a
common value, and all that name a value are linked to the smallest of them, so the work stays linear.

Cases: a null or blank text has fingerprint zero and links like any other. A text of one or two words is
one shingle. Repeated rows share fingerprint and component. A null doc_id takes part but is never a
component's name unless all in it are null. Very long texts are read whole, their bits summed by chunks. An
empty table gives an empty result. Only doc_id and text are read.
"""

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidmatrix.llm.common import ship, text_bytes
from bidmatrix.llm.components import connected_components
from bidmatrix.session import stored

SHINGLE = 3
SEED = 42
BITS = 64
BUCKET = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def masks() -> list[int]:
    """The seven bit masks, as signed 64-bit numbers."""
    odd = lambda v, i: ((i % 7 + 1) & v).bit_count() % 2
    return [_signed(sum(1 << i for i in range(BITS) if odd(v, i))) for v in range(1, 8)]


def fingerprint(text: bytes) -> int:
    """Fingerprint of a UTF-8 text, unsigned."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    n = max(1, len(words) - SHINGLE + 1)
    starts = [0, *ends][:n]
    stops = ends[min(len(words), SHINGLE) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, stops)), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        some = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += some.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            view = memoryview(data)
            found = [_signed(fingerprint(bytes(view[a:b]))) for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    chosen = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id bigint, fp bigint")


def links(nodes: DataFrame) -> DataFrame:
    """fp, near: pairs of distinct fingerprints within two bits, enough of them to connect all that are."""
    tables = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks()])).alias("t", "key"))
    sizes = stored(tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = stored(tables.join(sizes, ["t", "key"]))

    few = members.where(F.col("n") <= BUCKET)
    other = few.select("t", "key", F.col("fp").alias("near"))
    near = (F.col("near") < F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("near"))) <= 2)
    pairs = few.join(other, ["t", "key"]).where(near).select("fp", "near")

    many = members.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    named = stored(many.select("fp", F.explode(flips).alias("name")))
    least = stored(named.groupBy("name").agg(F.min("fp").alias("near"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    stars = named.join(least, "name").where(F.col("near") < F.col("fp")).select("fp", "near")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    found = stored(fingerprints(docs))
    nodes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(links(nodes), "fp", "near").withColumnRenamed("node", "fp")
    placed = stored(nodes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = stored(placed.join(stored(named), "component").select("fp", "component_id"))
    return found.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id, with its columns.

    The rows meet the kept ids and lose repeated rows in one shuffle, by a key that stands for a null doc_id too.
    """
    key = lambda doc_id: F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(2**63)))
    kept = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(key("doc_id").alias("simhash_key")).distinct()
    rows = docs.withColumn("simhash_key", key("doc_id")).withColumn("simhash_text", F.xxhash64("text"))
    rows = rows.join(kept, "simhash_key", "left_semi").dropDuplicates(["simhash_key", "simhash_text"])
    return rows.select(*docs.columns)

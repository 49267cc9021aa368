"""Target-distribution importance resampling over hashed word runs, with CRC-32 worked out for many runs at once.

A document's features are all runs of ``least`` to ``most`` consecutive words, joined by one space, repeats
counted; a feature falls into the bucket of its CRC-32. A bucket's gain is the rounded-down log ratio of its
smoothed share in the target texts to its smoothed share in the documents. Documents are drawn without
replacement by their summed gains plus keyed Gumbel noise, the highest scores first.

CRC-32 is linear over bits but for a constant of the length. So a byte contributes a fixed word that only
depends on its value and its distance from the end, looked up in a position table; a run's checksum is the XOR
of its bytes' words (``bitwise_xor.reduceat`` over the runs) and the constant of its length. Runs longer than
the table fold block by block: the checksum so far is carried over a block as four bytes in front of it.

The texts are read twice: once for the buckets' counts (a fixed number of them, summed within tasks first),
once for the documents' weights. Only the table of gains goes to the tasks, whose size is the number of buckets.

Cases: a null or empty text has no features and weight 0. Rows with repeated ids are documents of their own; a
null id draws the noise of an empty one. Equal scores go by smaller id (null last), then by fewer features and
smaller weight, so only rows alike in all of these change places. Empty tables of documents or of target texts
count nothing. Texts of any length are taken whole. Columns of the input other than the id and the text are ignored.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidmatrix.llm.common import global_rank, ship, text_pieces, word_spans
from bidmatrix.session import stored


@dataclass(frozen=True)
class Setting:
    least: int = 1  # words of a run
    most: int = 1
    buckets: int = 10_000
    percent: int = 10  # of the eligible documents are drawn
    words: int = 20  # that make a document eligible
    seed: int = 2024


# CRC-32 of many spans

#: Bytes of the position table; longer spans fold in blocks of this many.
BLOCK = 64
_POLYNOMIAL = 0xEDB88320


def position_table(block: int) -> np.ndarray:
    """(block, 256): what a byte adds to the checksum when so many bytes follow it."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLYNOMIAL), one >> 1)
    rows = [one]
    for _ in range(block - 1):  # one more zero byte behind it
        rows.append((rows[-1] >> 8) ^ one[rows[-1] & 255])
    return np.array(rows, dtype=np.uint32)


TABLE = position_table(BLOCK)


def carried(state: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The register after n zero bytes (4 to BLOCK): its four bytes are bytes in front of them."""
    out = np.zeros_like(state)
    for k in range(4):
        out ^= TABLE[n - 1 - k, (state >> np.uint32(8 * k)) & 255]
    return out


def _constants() -> np.ndarray:
    """Register after 0 to BLOCK zero bytes when it starts with all ones."""
    out = [np.uint32(0xFFFFFFFF)]
    for _ in range(BLOCK):
        out.append((out[-1] >> np.uint32(8)) ^ TABLE[0, out[-1] & 255])
    return np.array(out, dtype=np.uint32)


CONSTANTS = _constants()


def _folded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR of the bytes' contributions for non-empty spans of at most BLOCK bytes."""
    heads = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(int(lengths.sum())) - heads[of]
    return np.bitwise_xor.reduceat(TABLE[lengths[of] - 1 - within, data[starts[of] + within]], heads)


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """zlib's CRC-32 of data[start:end] for every span (uint32)."""
    lengths = ends - starts
    # a long span begins with its odd part, so that only whole blocks follow
    first = np.where(lengths > BLOCK, (lengths - 1) % BLOCK + 1, lengths)
    out = CONSTANTS[first].copy()
    full = np.flatnonzero(first)
    if len(full):
        out[full] ^= _folded(data, starts[full], first[full])
    at, left = starts + first, lengths - first
    rest = np.flatnonzero(left)
    while len(rest):
        block = np.full(len(rest), BLOCK)
        out[rest] = carried(out[rest], BLOCK) ^ _folded(data, at[rest], block)
        at[rest] += BLOCK
        left[rest] -= BLOCK
        rest = rest[left[rest] > 0]
    return ~out


# words and runs of them

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def features_of(data: np.ndarray, cuts: np.ndarray, setting: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of some texts, the text of each, and the number of words of every text."""
    starts, ends, text = word_spans(data, cuts)
    n_words = np.bincount(text, minlength=len(cuts) - 1)
    data, buckets, texts = _LOWER[data], [], []
    if setting.most > 1:  # the words again, with one space between them
        lengths = ends - starts
        heads = np.cumsum(lengths + 1) - lengths - 1
        of = np.repeat(np.arange(len(starts)), lengths)
        within = np.arange(int(lengths.sum())) - (np.cumsum(lengths) - lengths)[of]
        joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
        joined[heads[of] + within] = data[starts[of] + within]
        data, starts, ends = joined, heads, heads + lengths
    for n in range(setting.least, setting.most + 1):
        last = np.arange(n - 1, len(starts))
        last = last[text[last] == text[last - (n - 1)]]
        buckets.append(crc32_spans(data, starts[last - (n - 1)], ends[last]) % np.uint32(setting.buckets))
        texts.append(text[last])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(texts), n_words


# Spark

def bucket_counts(texts: DataFrame, column: str, setting: Setting) -> np.ndarray:
    """Features in each bucket over all texts; each task sends one row per bucket that it met."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(setting.buckets, np.int64)
        for batch in batches:
            for data, cuts in text_pieces(batch.column(0)):
                counts += np.bincount(features_of(data, cuts, setting)[0], minlength=setting.buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["bucket", "n"])

    found = texts.select(F.col(column).cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(setting.buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most setting.buckets rows
        out[row["bucket"]] = row["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: thousand times the log ratio of smoothed shares, rounded down."""
    n, s, t = len(documents), float(documents.sum()), float(target.sum())
    ratio = lambda x, y: (float(y) + 1.0) * (s + n) / ((float(x) + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(ratio(x, y))) for x, y in zip(documents.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, setting: Setting) -> DataFrame:
    """doc_id, n_features, weight and n_words of every document."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            columns = [[], [], []]
            for data, cuts in text_pieces(batch.column(1)):
                bucket, text, n_words = features_of(data, cuts, setting)
                order = np.argsort(text, kind="stable")
                sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                n = np.bincount(text, minlength=len(cuts) - 1)
                to = np.cumsum(n)
                for column, values in zip(columns, (n, sums[to] - sums[to - n], n_words)):
                    column.append(values)
            numbers = [pa.array(np.concatenate(c or [np.zeros(0)]).astype(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers], names=["doc_id", "n_features", "weight", "n_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_features bigint, weight bigint, n_words bigint"
    )


def resample(docs: DataFrame, target: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text); target has texts.

    rank is 1, 2, 3... for the drawn documents by falling score, null for the others.
    """
    gain = gains(bucket_counts(docs, "text", setting), bucket_counts(target, "text", setting))
    draw = F.concat(F.lit(f"{setting.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    share = F.conv(F.substring(F.sha2(draw, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((share + 0.5) / F.lit(4294967296.0)))).cast("bigint")
    scored = weighted(docs, gain, setting).withColumn("score", F.col("weight") + noise)
    eligible = F.col("n_words") >= setting.words
    # rows alike in all that orders them are told apart, so that no range of the order holds them all
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()))
    n_drawn = scored.where(eligible).count() * setting.percent // 100
    ranked = global_rank(
        scored, "place", F.when(eligible, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"),
        F.col("weight"), F.col("row"),
    )
    rank = F.when(eligible & (F.col("place") < n_drawn), F.col("place") + 1).cast("bigint")
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))

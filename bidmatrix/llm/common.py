"""What several operators share: tables, batches of text bytes, ranks, shipping the package to Python workers."""

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidmatrix.session import stored

#: A word of the white-space kind.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spaced_words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_bidmatrix_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="bidmatrix-"), "bidmatrix.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._bidmatrix_shipped = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column end to end, and where each value starts (one more at the end).

    Nulls count as empty. Nothing is copied per row.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (whole[starts[0] : starts[-1]], starts - starts[0]) if len(starts) else (whole[:0], np.zeros(1, np.int64))


#: Bytes of text that are worked on together; a longer text is one piece.
TOGETHER = 1 << 21


def text_pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The column's texts in runs of about TOGETHER bytes: the bytes, and where each text starts (one more at the end)."""
    data, cuts = text_bytes(column)
    at = 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + TOGETHER, side="right")) - 1)
        yield data[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at]
        at = to


#: Bytes of a word of letters and digits, in any script.
_IN_WORD = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def word_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in texts that lie end to end, and each one's text; cuts are the texts' starts and the end."""
    inside = _IN_WORD[data]
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    edges = cuts[1:-1]
    edges = edges[edges < len(data)]
    before[edges] = False  # no word goes on from one text into the next
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(cuts, starts, side="right") - 1


def global_rank(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with its row number from 0 in the given order, without one task that sees all rows.

    Rows are dealt out by ranges of the order and numbered inside each; the counts of the ranges
    before (one row per range) are added. Rows equal in the order are numbered arbitrarily.
    """
    part, inner = f"{name}__range", f"{name}__inner"
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    ranged = stored(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(inner + "0"))
    numbered = ranged.withColumn(inner, F.row_number().over(Window.partitionBy(part).orderBy(*keys)))
    return (
        numbered.join(F.broadcast(offsets), part)  # one row per range of the shuffle above
        .withColumn(name, F.col(inner) - 1 + F.col(inner + "0"))
        .drop(part, inner, inner + "0")
    )

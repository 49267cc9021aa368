"""Best-fit packing into fixed-length sequences, planned over the histogram of lengths.

Documents longer than a sequence are cut: full pieces fill a sequence each, and the remainder, the first
piece, is packed like a short document. The plan never sees documents: it takes the number of pieces per
length (at most one row per length), longest first, and puts each length where the least room is left
that still fits it. Sequences in the same state are one run of numbers, so a run is filled or split as a
whole. The plan is rows "ranks from..of length l lie in sequences s.. at offset o"; a piece finds its row
by its rank within its length. Ranks come from counts per (length, bucket), so a length that holds most
pieces is not ranked in one task.

Cases: a null or empty text is one piece of the end token. Repeated rows are packed each. Very long texts
give many pieces. An empty table gives an empty result. Only doc_id and text are read.
"""

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidmatrix.llm.common import ship, text_bytes
from bidmatrix.session import stored

SEQUENCE = 2048
END_ID = 0
#: Ranks one plan row covers at most after it is dealt out for the join.
BLOCK = 4096
#: Pieces of a length that one window ranks, about.
BUCKET = 4096

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(length: int, sequence: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: a shorter first one, if any, then full ones."""
    first = length % sequence
    starts = ([0] if first else []) + list(range(first, length, sequence))
    return [(s, first if s == 0 and first else sequence) for s in starts]


def cut_pieces(docs: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's tokens and end token."""
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bidmatrix.llm.tokens import encoder

        to_ids, end = encoder().ids, END_ID.to_bytes(4, "little")
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            data = memoryview(data)
            doc_ids, rows = batch.column("doc_id").to_pylist(), ([], [], [], [], [])
            for at, doc_id in enumerate(doc_ids):
                ids = to_ids(bytes(data[starts[at] : starts[at + 1]])) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, sequence)):
                    row = (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                    for column, value in zip(rows, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(encode, PIECES)


def plan_sequences(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, how many, first sequence, offset), from the number of pieces of each length.

    room: by room left, the runs (first sequence, how many) of sequences in that state.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            least = min((r for r, runs in room.items() if r >= length and runs), default=None)
            if least is None:
                bins = -(-left // (sequence // length))  # enough new sequences for all that is left
                room[sequence].append((opened, bins))
                opened += bins
                continue
            first, bins = room[least].pop()
            used = min(left, bins)
            rows.append((length, rank, used, first, sequence - least))
            if used < bins:
                room[least].append((first + used, bins - used))
            if least > length:
                room[least - length].append((first, used))
            left, rank = left - used, rank + used
    return rows


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """pieces (with piece lengths up to `sequence`) and their sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = stored(pieces.drop("sequence_id", "offset"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(
        plan_sequences(counts, sequence), "length long, rank long, n long, first long, at long"
    )
    blocks = F.expr(f"sequence(rank div {BLOCK}, (rank + n - 1) div {BLOCK})")
    plan = plan.select(F.col("length").alias("pack_length"), F.col("rank").alias("pack_from"), "n", "first", "at",
                       F.explode(blocks).alias("pack_block"))

    # rank within the length: documents of earlier buckets, and the place in the own bucket
    total = max(1, sum(counts.values()))
    buckets = -(-total // BUCKET)
    dealt = pieces.withColumn("pack_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "pack_bucket").agg(F.count(F.lit(1)).alias("pack_n"))
    running = Window.partitionBy("length").orderBy("pack_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "pack_bucket", F.coalesce(F.sum("pack_n").over(running), F.lit(0)).alias("pack_before"))
    place = F.row_number().over(Window.partitionBy("length", "pack_bucket").orderBy("doc_id", "piece")) - 1
    ranked = (
        dealt.withColumn("pack_place", place)
        .join(before, ["length", "pack_bucket"])
        .withColumn("pack_rank", F.col("pack_before") + F.col("pack_place"))
        .withColumn("pack_block", F.expr(f"pack_rank div {BLOCK}"))
    )
    spot = (ranked["length"] == plan["pack_length"]) & (ranked["pack_block"] == plan["pack_block"])
    inside = (ranked["pack_rank"] >= plan["pack_from"]) & (ranked["pack_rank"] < plan["pack_from"] + plan["n"])
    return ranked.join(plan, spot & inside).select(
        *[ranked[c] for c in pieces.columns],
        (plan["first"] + ranked["pack_rank"] - plan["pack_from"]).alias("sequence_id"),
        plan["at"].alias("offset"),
    )


def pack_documents(docs: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    return pack(cut_pieces(docs, sequence), sequence)

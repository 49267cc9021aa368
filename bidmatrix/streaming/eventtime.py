"""Streams by event time: records that come late, out of order and repeatedly, in state that empties again.

``delay`` is how much later than a record's time it may still come. A record within it counts, and counts once
however often it is sent: its id is kept until no repetition can be in time any more. Totals are kept as sums
per micro-batch and added up when read, so a late record only adds to its day and nothing is rewritten; a
batch that runs again replaces its own sums. Records later than ``delay`` are left out by Spark, which counts
them: ``left_out``.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once(records: DataFrame, at: str, delay: str, id_column: str) -> DataFrame:
    """Records with a time, each id's first one. A record without an id is told apart by all that it holds."""
    told_apart = F.coalesce(F.col(id_column).cast("string"), F.sha2(F.to_json(F.struct(*records.columns)), 256))
    timed = records.where(F.col(at).isNotNull()).withColumn("record_key", told_apart)
    return timed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["record_key"]).drop("record_key")


def start_totals(records: DataFrame, by: list[str], sums: dict[str, Column], path: str, checkpoint: str) -> StreamingQuery:
    """Keep the number of records and their sums per ``by``; runs until what is there now is taken in."""

    def add(batch: DataFrame, number: int) -> None:
        totals = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"), *[F.sum(c).alias(name) for name, c in sums.items()])
        totals.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str, by: list[str], sums: list[str]) -> DataFrame:
    kept = spark.read.parquet(path)
    return kept.groupBy(*by).agg(F.sum("n_records").alias("n_records"), *[F.sum(s).alias(s) for s in sums])


def start_sittings(records: DataFrame, owner: str, at: str, delay: str, gap: str, sums: dict[str, Column], path: str, checkpoint: str) -> StreamingQuery:
    """Write each owner's runs of records without a pause of more than ``gap`` once no record can join them any more.

    A run's rows are owner, started, ended, n_records and ``sums``. Its state is one row until it closes.
    """
    run = F.session_window(at, gap)
    closed = records.withWatermark(at, delay).groupBy(owner, run).agg(
        F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("n_records"), *[F.sum(c).alias(name) for name, c in sums.items()]
    ).drop("session_window")
    writer = closed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def _operators(query: StreamingQuery) -> list[list[dict]]:
    return [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]


def left_out(query: StreamingQuery) -> int:
    """Records of this run that came later than their delay."""
    return sum(o["numRowsDroppedByWatermark"] for operators in _operators(query) for o in operators)


def held(query: StreamingQuery) -> int:
    """Rows in the query's state after its last batch."""
    operators = _operators(query)
    return sum(o["numRowsTotal"] for o in operators[-1]) if operators else 0

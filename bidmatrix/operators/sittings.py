"""Runs of events with no long pause in between ("sittings"), per owner, without a task that sees a whole owner.

Time is cut into bins. Inside an owner's bin, a pause of more than the gap begins a new run. Of each bin, only
its first and last time and its number of pauses go on to the owner's window over bins, which tells how many
runs began before a bin and whether its first one goes on from an earlier bin. That numbers all runs, and
their parts are added up by number. An owner may hold any share of all events: rows are only sorted within
(owner, bin), and the window over bins has one row per bin.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(column: str) -> Column:
    """Whole microseconds since 1970 of a timestamp without zone, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")


def sittings(events: DataFrame, owner: str, at: str, gap: int, bin_size: int, **sums: Column) -> DataFrame:
    """owner, sitting_no (from 1), started, ended, n_events and ``sums`` of each run.

    ``at`` is a whole number; more than ``gap`` between neighbours begins a new run. Events without a time
    belong to none; those without an owner are one owner's.
    """
    values = [value.alias(name) for name, value in sums.items()]
    timed = events.where(F.col(at).isNotNull()).select(F.col(owner).alias("owner"), F.col(at).alias("at"), *values)
    timed = timed.withColumn("bin", F.floor(F.col("at") / bin_size).cast("bigint"))
    inside = Window.partitionBy("owner", "bin").orderBy("at")
    pause = F.coalesce((F.col("at") - F.lag("at").over(inside) > gap).cast("int"), F.lit(0))
    local = timed.withColumn("pause", pause).withColumn("local_no", F.sum("pause").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    parts = local.groupBy("owner", "bin", "local_no").agg(
        F.min("at").alias("started"), F.max("at").alias("ended"), F.count(F.lit(1)).alias("n_events"), *[F.sum(s).alias(s) for s in sums]
    )
    bins = parts.groupBy("owner", "bin").agg(F.min("started").alias("first"), F.max("ended").alias("last"), F.max("local_no").alias("pauses"))
    by_bin = Window.partitionBy("owner").orderBy("bin")
    apart = F.coalesce((F.col("first") - F.lag("last").over(by_bin) > gap).cast("int"), F.lit(1))
    offsets = bins.withColumn("apart", apart).select(
        F.col("owner").alias("o"), F.col("bin").alias("b"),
        (F.sum(F.col("apart") + F.col("pauses")).over(by_bin) - F.col("pauses")).alias("offset"),
    )
    numbered = parts.join(offsets, F.col("owner").eqNullSafe(F.col("o")) & (F.col("bin") == F.col("b")))
    return numbered.groupBy(F.col("owner").alias(owner), (F.col("offset") + F.col("local_no")).alias("sitting_no")).agg(
        F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n_events").alias("n_events"),
        *[F.sum(s).alias(s) for s in sums],
    )

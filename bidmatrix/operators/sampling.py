"""Samples of a fixed size per group that are alike on every run and in parts, and estimates from them.

Each unit (rows alike in the unit's columns) gets a number from a keyed hash of those columns. A group's sample is
its ``size`` units with the smallest numbers; the next one's number is the threshold below which all were taken,
so every unit of the group was in with a chance of threshold / SPAN, and values divided by it add up to an unbiased
estimate. The smallest of parts' smallest are the smallest of all, so samples of batches can be joined.
Spark cuts a group to its smallest before the shuffle (WindowGroupLimit).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers are below this (48 bits of the hash).
SPAN = 1 << 48


def units(rows: DataFrame, by: list[str], unit: list[str], value: str, seed: int) -> DataFrame:
    """by, unit, their number, how many rows are alike and the sum of their values (null: 0)."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    told = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[named(c) for c in unit]), 256)
    alike = rows.groupBy(*by, *unit).agg(F.count(F.lit(1)).alias("n_alike"), F.sum(F.coalesce(value, F.lit(0))).alias("value"))
    return alike.withColumn("number", F.conv(F.substring(told, 1, 12), 16, 10).cast("bigint"))


def smallest(numbered: DataFrame, by: list[str], unit: list[str], size: int) -> DataFrame:
    """The size + 1 units of each group with the smallest numbers, ``place`` from 1. Also joins parts: pass their union."""
    order = Window.partitionBy(*by).orderBy("number", *unit)
    return numbered.drop("place").withColumn("place", F.row_number().over(order)).where(F.col("place") <= size + 1)


def sample(lowest: DataFrame, by: list[str], size: int) -> DataFrame:
    """The sampled units with their group's ``threshold`` (SPAN where the whole group is in)."""
    whole = Window.partitionBy(*by)
    threshold = F.coalesce(F.max(F.when(F.col("place") == size + 1, F.col("number"))).over(whole), F.lit(SPAN))
    return lowest.withColumn("threshold", threshold).where(F.col("place") <= size)


def estimates(sampled: DataFrame, by: list[str]) -> DataFrame:
    """Per group: units sampled, threshold, and estimates of its rows and of its values' sum."""
    scaled = lambda c: F.floor(F.col(c).cast("double") * SPAN / F.col("threshold"))
    sums = sampled.groupBy(*by, "threshold").agg(F.count(F.lit(1)).alias("n_sampled"), F.sum("n_alike").alias("n"), F.sum("value").alias("v"))
    return sums.select(*by, "n_sampled", "threshold", scaled("n").alias("estimated_rows"), scaled("v").alias("estimated_sum"))

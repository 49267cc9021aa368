"""Joins along time: the last row in force at a moment (as-of), and spans that overlap, per key.

Neither compares a key's rows pair by pair or sorts a whole key in one task. Times are whole numbers (days,
microseconds); a key may hold any share of all rows.

As-of: time is cut into bins. What a bin passes on is its last row, so a key's window over bins has one row
per bin that holds or asks for something; inside (key, bin), a row holds until the next one's time, and what earlier
bins passed on until the first one's. The rows that ask are moved once: they meet the spans of their own bin by equality of
key and bin, so a row is compared with as many as its bin holds distinct times, and Spark can split a hot one.

Overlaps: each span gets a level by its length, the smallest whose bins are at least as long, so it touches at
most two bins of its own level or of a coarser one. Two spans are compared only in the bins of the coarser of
their levels, and reported in the bin in which their common part begins.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of each level are this many times as long as those of the level below.
GROWTH = 4


def as_of(asking: DataFrame, given: DataFrame, key: str, at: str, since: str, bin_size: int, order: list[str]) -> DataFrame:
    """Each row of ``asking`` with the columns of the last row of ``given`` of its key with ``since`` <= ``at``.

    Rows of ``given`` at the same time: the one whose columns ``order`` are largest. Rows that ask without a key
    or a time, or before the first row, get nulls; rows of ``given`` without a key or a time are never in force.
    Columns of ``given`` other than the key must not occur in ``asking``.
    """
    brought = [c for c in given.columns if c != key]
    lead = [since, *order]
    packed = F.struct(*lead, *[c for c in brought if c not in lead]).alias("in_force")
    bin_of = lambda moment: F.floor(moment / bin_size).cast("bigint")
    timed = given.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("k"), bin_of(F.col(since)).alias("bin"), F.col(since).alias("from"), packed)
    moments = timed.groupBy("k", "bin", "from").agg(F.max("in_force").alias("in_force"))
    asked = asking.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), bin_of(F.col(at)).alias("bin")).distinct()
    ends = moments.groupBy("k", "bin").agg(F.min("from").alias("to"), F.max("in_force").alias("in_force"))
    bins = ends.unionByName(asked, allowMissingColumns=True).groupBy("k", "bin").agg(F.min("to").alias("to"), F.max("in_force").alias("in_force"))
    over_bins = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    earlier = bins.withColumn("in_force", F.last("in_force", True).over(over_bins)).where("in_force is not null")
    inside = Window.partitionBy("k", "bin").orderBy("from")
    held = moments.withColumn("to", F.lead("from").over(inside))
    spans = held.unionByName(earlier.withColumn("from", F.col("in_force")[since])).select(
        F.col("k").alias("in_force_key"), F.col("bin").alias("in_force_bin"), F.col("from").alias("in_force_from"), F.col("to").alias("in_force_to"), "in_force"
    )
    open_at = (F.col(at) >= F.col("in_force_from")) & (F.col("in_force_to").isNull() | (F.col(at) < F.col("in_force_to")))
    met = asking.join(spans, (F.col(key) == F.col("in_force_key")) & (bin_of(F.col(at)) == F.col("in_force_bin")) & open_at, "left")
    return met.select(*asking.columns, *[F.col("in_force")[c].alias(c) for c in brought])


def _level(length: Column, levels: int) -> Column:
    """The number of bin lengths GROWTH ** level that are shorter than ``length``."""
    return sum(((length > GROWTH**i).cast("int") for i in range(levels)), F.lit(0))


def overlaps(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], levels: int = 12) -> DataFrame:
    """Pairs of rows of one key whose spans [from, to) share a moment, with the shared part's ``shared_from`` and ``shared_to``.

    Spans without a key, a beginning or an end, and empty ones, pair with nothing. ``levels`` bounds how often a
    span is repeated; GROWTH ** levels is the length from which spans share the coarsest bins whatever their
    length. Columns other than the key must differ between the sides.
    """

    def placed(rows: DataFrame, begin: str, end: str, side: str, deepest: int) -> DataFrame:
        real = rows.where(F.col(key).isNotNull() & (F.col(begin) < F.col(end)))
        own = F.least(_level(F.col(end) - F.col(begin), levels), F.lit(levels))
        with_level = real.withColumn(f"{side}_level", own)
        reach = with_level.withColumn("level", F.explode(F.sequence(f"{side}_level", F.lit(deepest))))
        size = F.pow(F.lit(GROWTH), F.col("level")).cast("bigint")
        first, last = F.floor(F.col(begin) / size), F.floor((F.col(end) - 1) / size)
        return reach.withColumn("bin", F.explode(F.sequence(first, last)))

    # coarser levels than the longest span of the other side have no partner there
    longest = lambda rows, span: rows.agg(F.max(F.least(_level(F.col(span[1]) - F.col(span[0]), levels), F.lit(levels)))).first()[0] or 0
    deepest = max(longest(left, left_span), longest(right, right_span))
    a = placed(left, *left_span, "left", deepest)
    b = placed(right, *right_span, "right", deepest).withColumnsRenamed({key: "right_key", "level": "met_level", "bin": "met_bin"})
    # Spark takes a side's size before its spans are repeated: without the hint it would send them all through the driver
    b = b.hint("merge")
    met = a.join(b, (F.col(key) == F.col("right_key")) & (F.col("level") == F.col("met_level")) & (F.col("bin") == F.col("met_bin")))
    begins, ends = F.greatest(left_span[0], right_span[0]), F.least(left_span[1], right_span[1])
    size = F.pow(F.lit(GROWTH), F.col("level")).cast("bigint")
    real = (F.col("level") == F.greatest("left_level", "right_level")) & (begins < ends) & (F.floor(begins / size) == F.col("bin"))
    return met.where(real).select(*left.columns, *[c for c in right.columns if c != key], begins.alias("shared_from"), ends.alias("shared_to"))

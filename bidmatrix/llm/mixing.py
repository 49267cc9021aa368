"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A source's target is its share of the wanted words by weight. A source may be repeated at most
`max_epochs` times, so a target stops there, and what it leaves is shared again by weight among the
sources that are not full. In the end every target is min(cap, level * weight) for one level.

A target of e.g. 1.4 epochs means each document once, and 0.4 of the source's words once more: the
documents in the order of a keyed hash until the words are reached. The document at the border counts in
part, so a source meets its target to the word; `repeat_documents` takes it whole or not at all, whichever is
nearer. Only the documents of one bucket per source, the one with the border, are put in order; for all others
their bucket tells what is taken, without moving their texts.

Cases: a null or blank text has size 0 and is taken 0 times. A null source is a source of its own,
last in order. Repeated rows count each. An empty table gives an empty result. Columns of the input
whose names clash with the added ones are replaced.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidmatrix.llm.common import global_rank, spaced_words
from bidmatrix.session import stored


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)  # by source in code point order, repeating
    share: float = 1.5  # wanted words, as a multiple of all words
    max_epochs: int = 2
    seed: str = "mix-1"
    bucket_rows: int = 4096  # documents of a source that one window ranks, about


ADDED = ("size", "source_size", "target", "taken")


def water_level(sources: DataFrame, wanted: float, max_epochs: int) -> float:
    """The level at which the targets min(cap, level * weight) add up to `wanted`.

    Each round fills the sources that stay below the level so far; only sums reach the driver.
    The level only rises, so a source once full stays full, and the rounds end.
    """
    level, full = 0.0, -1
    while True:
        cap = F.col("source_size") * F.lit(max_epochs)
        at_cap = (F.lit(full >= 0)) & (cap <= F.lit(level) * F.col("weight"))
        row = sources.agg(
            F.count(F.when(at_cap, 1)).alias("full"),
            F.sum(F.when(at_cap, cap)).alias("given"),
            F.sum(F.when(~at_cap, F.col("weight"))).alias("open"),
        ).first()
        if row["full"] == full or not row["open"]:
            return level
        full, level = row["full"], (wanted - (row["given"] or 0)) / row["open"]


def plan_sources(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size, n_docs, target: one row per source, from rows of source and size."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = global_rank(totals, "mix_rank", F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(w) for w in mix.weights])
    at = (F.col("mix_rank") % len(mix.weights)).cast("int")
    weighed = stored(ranked.withColumn("weight", F.get(cycle, at).cast("long")))
    words = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(weighed, mix.share * words, mix.max_epochs)
    cap = (F.col("source_size") * mix.max_epochs).cast("double")
    return weighed.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Every row of docs with size, source_size, target and taken (words the mix takes, repeats counted)."""
    docs = docs.drop(*ADDED)
    sizes = stored(docs.select("doc_id", "source", spaced_words(F.col("text")).alias("size")))
    draw = F.md5(F.concat(F.lit(mix.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    low = F.conv(F.substring("mix_draw", 1, 8), 16, 10).cast("long")

    # whole epochs and words beyond them, per source
    words = F.floor(F.col("target") + 0.5).cast("long")
    plan = (
        plan_sources(sizes.select("source", "size"), mix)
        .withColumn("mix_whole", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0))
        .withColumn("mix_rest", words - F.col("mix_whole") * F.col("source_size"))
        .withColumn("mix_buckets", F.ceil(F.col("n_docs") / mix.bucket_rows))
        .select(F.col("source").alias("mix_source"), "mix_rank", "source_size", "target", "mix_whole", "mix_rest", "mix_buckets")
    )
    plan = stored(plan)
    bucket = F.floor(low * F.col("mix_buckets") / F.lit(2**32)).cast("long")

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows with their source's plan and their bucket: ranges of the keyed hash, so buckets are in its order."""
        return (
            rows.withColumn("mix_draw", draw)
            .join(plan, F.col("source").eqNullSafe(F.col("mix_source")))
            .withColumn("mix_bucket", bucket)
        )

    sums = dealt(sizes).groupBy("mix_rank", "mix_bucket", "mix_rest").agg(
        F.sum("size").alias("mix_sum")
    )
    running = Window.partitionBy("mix_rank").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    border = (
        sums.withColumn("mix_before", F.coalesce(F.sum("mix_sum").over(running), F.lit(0)))
        .where((F.col("mix_before") < F.col("mix_rest")) & (F.col("mix_before") + F.col("mix_sum") >= F.col("mix_rest")))
        .select("mix_rank", F.col("mix_bucket").alias("mix_border"), "mix_before")
    )
    plan = stored(plan.join(border, "mix_rank", "left"))

    met = dealt(docs)
    at_border = F.coalesce(F.col("mix_bucket") == F.col("mix_border"), F.lit(False))
    apart = met.where(~at_border).withColumn("size", spaced_words(F.col("text")))
    apart = apart.withColumn("mix_extra", F.when(F.col("mix_bucket") < F.col("mix_border"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("mix_rank", "mix_bucket").orderBy("mix_draw", "size")
    ahead = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("mix_rest") - F.col("mix_before") - ahead
    ordered = met.where(at_border).withColumn("size", spaced_words(F.col("text")))
    ordered = ordered.withColumn("mix_extra", F.greatest(F.lit(0), F.least(left, F.col("size"))))
    both = apart.unionByName(ordered)
    taken = both.withColumn("taken", (F.col("mix_whole") * F.col("size") + F.col("mix_extra")).cast("long"))
    return taken.select(*docs.columns, *ADDED)


def repeat_documents(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each repetition. A border document is repeated whole, as often as is nearest to its taken words."""
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0)
    rows = mixed.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(True), times.cast("int"))))
    return rows.drop("mix_copy", *ADDED)

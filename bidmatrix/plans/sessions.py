"""State of each session: can it be compared, and what is missing if not."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_status(sessions: DataFrame, quotes: DataFrame, items: DataFrame) -> DataFrame:
    """ok / no_items / no_quotes per requested session, with its quote and line counts."""
    keys = ["session_id", "quote_id"]
    per_quote = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"))
    counts = (
        quotes.select(*keys)
        .join(per_quote, keys, "left")
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("n_quotes"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"))
    )
    n_quotes = F.coalesce("n_quotes", F.lit(0))
    n_items = F.coalesce("n_items", F.lit(0))
    status = F.when(n_quotes == 0, "no_quotes").when(n_items == 0, "no_items").otherwise("ok")
    return sessions.select("session_id").distinct().join(counts, "session_id", "left").select(
        "session_id", n_quotes.alias("n_quotes"), n_items.alias("n_items"), status.alias("status")
    )


def comparable_sessions(quotes: DataFrame, at_least: int = 2) -> DataFrame:
    """Sessions with enough different quotes to compare."""
    distinct = quotes.select("session_id", "quote_id").distinct()
    counted = distinct.groupBy("session_id").agg(F.count("quote_id").alias("n_quotes"))
    return counted.where(F.col("session_id").isNotNull() & (F.col("n_quotes") >= at_least))


def orphan_quotes(quotes: DataFrame, items: DataFrame) -> DataFrame:
    """Quotes no line belongs to; they appear in no comparison."""
    return quotes.join(items.select("quote_id").distinct(), "quote_id", "left_anti")


def session_items(items: DataFrame, quotes: DataFrame) -> DataFrame:
    """Lines of the given quotes only."""
    return items.join(quotes.select("session_id", "quote_id").distinct(), ["session_id", "quote_id"], "left_semi")

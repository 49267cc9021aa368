"""Each price against its baseline and its vendor's total; category roll-ups; arithmetic checks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidmatrix.functions.money import percent
from bidmatrix.operators.matrix import baseline
from bidmatrix.schemas import ROW


def deviation(cells: DataFrame) -> DataFrame:
    """Provided cells with their absolute and percent deviation from the baseline."""
    c, b = F.col("amount_cents"), F.col("baseline_cents")
    side = F.when(c > b, "above").when(c < b, "below").otherwise("at")
    return (
        cells.where(c > 0)
        .join(baseline(cells), ROW)
        .select(
            *ROW, "vendor", "n_providers", "amount_cents", "baseline_cents",
            (c - b).alias("deviation_cents"),
            percent(c - b, b).alias("deviation_pct"),
            side.alias("position"),
        )
    )


def red_flags(cells: DataFrame, threshold_pct: int = 50) -> DataFrame:
    """Cells at least ``threshold_pct`` percent away from a baseline of two or more vendors."""
    far = F.abs("deviation_cents") * 100 >= F.col("baseline_cents") * threshold_pct
    return deviation(cells).where((F.col("n_providers") >= 2) & far)


def service_share(cells: DataFrame) -> DataFrame:
    """Each cell as a share of its vendor's total."""
    keys = ["session_id", "vendor"]
    totals = cells.groupBy(*keys).agg(F.sum("amount_cents").alias("vendor_cents"))
    share = percent(F.col("amount_cents"), F.col("vendor_cents"))
    return cells.join(totals, keys).select(
        *ROW, "vendor", "amount_cents", "vendor_cents", share.alias("share_pct")
    )


def cheapest_vendor(cells: DataFrame) -> DataFrame:
    """Lowest price of each provided service and who asks it (ties by label)."""
    return cells.where("amount_cents > 0").groupBy(*ROW).agg(
        F.min_by("vendor", F.struct("amount_cents", "vendor")).alias("vendor"),
        F.min("amount_cents").alias("amount_cents"),
        F.max("amount_cents").alias("highest_cents"),
    )


def category_rollup(cells: DataFrame) -> DataFrame:
    """Category totals per vendor, per category and per session in one pass."""
    cols = [F.col("session_id"), F.col("service_category"), F.col("vendor")]
    summed = cells.groupingSets([cols, cols[:2], cols[:1]], *cols).agg(
        F.sum("amount_cents").alias("total_cents"),
        F.grouping_id().cast("bigint").alias("level"),
    )
    return summed.select("session_id", "service_category", "vendor", "level", "total_cents")


def category_heatmap(cells: DataFrame) -> DataFrame:
    """Category x vendor amounts with the category's share of the vendor's total."""
    keys = ["session_id", "vendor"]
    by_category = cells.groupBy("session_id", "service_category", "vendor").agg(
        F.sum("amount_cents").alias("amount_cents")
    )
    totals = by_category.groupBy(*keys).agg(F.sum("amount_cents").alias("vendor_cents"))
    share = percent(F.col("amount_cents"), F.col("vendor_cents"))
    return by_category.join(totals, keys).select(
        "session_id", "service_category", "vendor", "amount_cents", share.alias("share_pct")
    )


def category_columns(cells: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """The heat map with one column per category of the data, one row per session and vendor.

    Given ``categories`` are looked up nowhere; without them Spark finds the distinct ones first.
    """
    grouped = cells.groupBy("session_id", "vendor").pivot("service_category", categories)
    return grouped.agg(F.sum("amount_cents")).na.fill(0)


def amount_check(items: DataFrame, tolerance_cents: int = 0) -> DataFrame:
    """Lines whose amount is not quantity x rate."""
    expected = F.round(F.col("quantity") * F.col("rate_cents")).cast("bigint")
    diff = F.col("amount_cents") - expected
    return items.select(
        "session_id", "quote_id", *ROW[1:], "work_title", "quantity", "rate_cents", "amount_cents",
        diff.alias("diff_cents"),
    ).where(F.abs("diff_cents") > tolerance_cents)


def total_check(items: DataFrame, quotes: DataFrame) -> DataFrame:
    """Stated grand total of each quote against the sum of its lines (the rest is tax); no lines sum to 0."""
    keys = ["session_id", "quote_id"]
    sums = items.groupBy(*keys).agg(
        F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("items_cents"), F.count(F.lit(1)).alias("n_items")
    )
    items_cents = F.coalesce("items_cents", F.lit(0))
    diff = F.col("grand_total_cents") - items_cents
    return quotes.select(*keys, "grand_total_cents").join(sums, keys, "left").select(
        *keys, F.coalesce("n_items", F.lit(0)).alias("n_items"), items_cents.alias("items_cents"), "grand_total_cents",
        diff.alias("diff_cents"), percent(diff, items_cents).alias("diff_pct"),
    )

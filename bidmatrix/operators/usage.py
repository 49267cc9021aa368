"""What grounds a follow-up question: frequent sub-services, their mean rates and specifications.

Everything here starts from ``service_lines``, one row per group of equal lines, so line items are
read once; callers that need several results store it.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidmatrix.functions.money import mean_cents
from bidmatrix.functions.text import vendor_label

TOP = 20
_SERVICE = ["session_id", "sub_service"]


def service_lines(items: DataFrame, *detail: str) -> DataFrame:
    """Line count and rate sum per session, sub-service and the ``detail`` columns
    (any of vendor, description), whatever the category."""
    label = vendor_label(F.col("vendor_name"), F.col("source_filename"))
    labelled = items.where("session_id is not null and sub_service is not null").withColumn("vendor", label)
    return labelled.groupBy(*_SERVICE, *detail).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("rate_cents").alias("rate_sum"),
        F.count("rate_cents").alias("n_rates"),
    )


def lines_of_sums(sums: DataFrame, *detail: str) -> DataFrame:
    """``service_lines`` from lines that are summed already (n_items, rate_cents, n_rates) per quote and more."""
    label = vendor_label(F.col("vendor_name"), F.col("source_filename"))
    labelled = sums.where("session_id is not null and sub_service is not null").withColumn("vendor", label)
    return labelled.groupBy(*_SERVICE, *detail).agg(
        F.sum("n_items").alias("n_lines"), F.sum("rate_cents").alias("rate_sum"), F.sum("n_rates").alias("n_rates")
    )


def top_services(lines: DataFrame, k: int = TOP) -> DataFrame:
    """The k most frequent sub-services of each session, ties by name.

    Every task keeps only its own first k before the shuffle, so session size does not matter.
    """
    counts = lines.groupBy(*_SERVICE).agg(F.sum("n_lines").alias("n"))
    w = Window.partitionBy("session_id").orderBy(F.desc("n"), "sub_service")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_overall(items: DataFrame, k: int = TOP) -> DataFrame:
    """The k most frequent sub-services of the given lines, all sessions together."""
    counts = items.where("sub_service is not null").groupBy("sub_service").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "sub_service").limit(k)


def rate_means(lines: DataFrame, k: int = TOP) -> DataFrame:
    """Mean line rate of the top sub-services per vendor, zeros in, nulls out.

    ``lines`` carry vendor. A vendor none of whose lines has a rate has a null mean.
    """
    rates = (
        lines.where("vendor is not null")
        .groupBy(*_SERVICE, "vendor")
        .agg(F.sum("rate_sum").alias("total"), F.sum("n_rates").alias("n_rates"))
    )
    mean = F.when(F.col("n_rates") > 0, mean_cents(F.col("total"), F.col("n_rates")))
    return rates.join(top_services(lines, k), _SERVICE, "left_semi").select(
        *_SERVICE, "vendor", "n_rates", mean.alias("mean_rate_cents")
    )


def item_specs(lines: DataFrame, k: int = TOP) -> DataFrame:
    """Distinct descriptions of the top sub-services per vendor, nulls kept.

    ``lines`` carry vendor and description.
    """
    specs = lines.select(*_SERVICE, "vendor", "description").distinct()
    return specs.join(top_services(lines, k), _SERVICE, "left_semi")

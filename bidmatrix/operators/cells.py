"""The joined line-item frame and its first aggregate, the vendor x service cells."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidmatrix.functions.text import vendor_label
from bidmatrix.schemas import ROW


def join_quotes(quote_items: DataFrame, quotes: DataFrame) -> DataFrame:
    """Line items with the attributes of their quote. Items and quotes without partner drop out.

    The session is part of both tables and of the join, so a session filter on the result
    reaches both scans.
    """
    attributes = quotes.select(
        "session_id", "quote_id", "vendor_name", "source_filename", "quote_date", "grand_total_cents"
    )
    return quote_items.join(attributes, ["session_id", "quote_id"])


def cells(items: DataFrame) -> DataFrame:
    """Amount per session, category, sub-service and vendor label.

    ``items`` is the joined frame. Rows without a session, category, sub-service or label form
    no group; a group without any amount is 0.
    """
    label = vendor_label(F.col("vendor_name"), F.col("source_filename"))
    keyed = items.select(*ROW, label.alias("vendor"), "amount_cents").dropna(subset=[*ROW, "vendor"])
    return keyed.groupBy(*ROW, "vendor").agg(
        F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("amount_cents")
    )


def cells_of_tables(quote_items: DataFrame, quotes: DataFrame) -> DataFrame:
    """Same result from the two stored tables, summing per quote before the join.

    A quote that holds a large share of all lines shrinks to its distinct services first, so the
    join on quote_id moves one row per (quote, service) instead of one per line.
    """
    per_quote = (
        quote_items.dropna(subset=ROW)
        .groupBy("session_id", "quote_id", "service_category", "sub_service")
        .agg(F.sum("amount_cents").alias("amount_cents"))
    )
    return cells(join_quotes(per_quote, quotes))


def vendors(cells: DataFrame) -> DataFrame:
    """The distinct vendor labels of each session."""
    return cells.select("session_id", "vendor").distinct()

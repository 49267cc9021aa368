"""Labels against the service word bank, and required fields of a line."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidmatrix.functions.text import normalised
from bidmatrix.schemas import SERVICE


def labels_in_use(items: DataFrame) -> DataFrame:
    """Distinct (category, sub-service) labels with their line count."""
    return items.groupBy(*SERVICE).agg(F.count(F.lit(1)).alias("n_items"))


def violations(items: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Labels that are no entry of the word bank."""
    return labels_in_use(items).join(taxonomy, SERVICE, "left_anti")


def conforming(items: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Lines whose label is an entry of the word bank."""
    return items.join(taxonomy, SERVICE, "left_semi")


def snap(items: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The closest entry of the same category for every label in use (ties by name).

    Only distinct labels are compared, and only with the entries of their own category. A label of
    a category without entries, or of none, keeps its row and snaps to null.
    """
    entries = taxonomy.select("service_category", F.col("sub_service").alias("entry"))
    distance = F.levenshtein(normalised(F.col("sub_service")), normalised(F.col("entry")))
    return (
        labels_in_use(items)
        .join(entries, "service_category", "left")
        .withColumn("distance", distance)
        .groupBy(*SERVICE)
        .agg(
            F.min_by("entry", F.struct("distance", "entry")).alias("snapped"),
            F.min("distance").alias("distance"),
        )
    )


#: Blocks that the word bank is dealt over, and tasks that each of them meets the sessions in.
BLOCKS, SALTS = 64, 16


def uncovered(cells: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Word-bank entries no vendor of the session quotes.

    The bank is dealt over blocks by hash, and every session meets it block by block, so no array holds more
    than a block of it and no session's labels come together in one row.
    """
    entry = F.struct(*SERVICE)
    block = F.pmod(F.xxhash64(*SERVICE), F.lit(BLOCKS)).cast("int")
    bank = taxonomy.select(*SERVICE).distinct()
    quoted = (
        cells.select("session_id", *SERVICE).distinct()
        .join(bank, SERVICE, "left_semi")
        .groupBy("session_id", block.alias("block")).agg(F.collect_list(entry).alias("quoted"))
    )
    blocks = bank.groupBy(block.alias("block")).agg(F.collect_list(entry).alias("entries"))
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sessions = cells.select("session_id").distinct().withColumn("salt", F.pmod(F.xxhash64("session_id"), F.lit(SALTS)).cast("int"))
    sessions = sessions.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    none = F.array().cast("array<struct<service_category:string,sub_service:string>>")
    missing = F.explode(F.array_except("entries", F.coalesce("quoted", none)))
    met = sessions.join(blocks, ["block", "salt"]).join(quoted, ["session_id", "block"], "left")
    return met.select("session_id", missing.alias("e")).select("session_id", "e.*")


def coverage(cells: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Per session and category with gaps: how many word-bank entries are not quoted."""
    return uncovered(cells, taxonomy).groupBy("session_id", "service_category").agg(
        F.count(F.lit(1)).alias("n_uncovered")
    )


def field_problems(items: DataFrame) -> DataFrame:
    """Lines with the required fields they lack, as ``problems array<string>``."""
    text = ["service_category", "sub_service", "pricing_method"]
    checks = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in text]
    checks += [F.when(F.col(c).isNull(), F.lit(c)) for c in ("quantity", "rate_cents", "amount_cents")]
    return items.withColumn("problems", F.array_compact(F.array(*checks)))


def quote_problems(quotes: DataFrame, items: DataFrame) -> DataFrame:
    """Quotes with the required fields they lack, as ``problems array<string>``; no line at all counts as no services."""
    keys = ["session_id", "quote_id"]
    served = items.select(*keys).distinct().withColumn("served", F.lit(True))
    text = ["vendor_name", "client_name", "quote_date"]
    checks = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in text]
    checks += [F.when(F.col("grand_total_cents").isNull(), F.lit("grand_total")), F.when(F.col("served").isNull(), F.lit("services"))]
    return quotes.join(served, keys, "left").withColumn("problems", F.array_compact(F.array(*checks))).drop("served")

"""The comparison matrix: a baseline per service and every vendor's amount for it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidmatrix.functions.money import mean_cents
from bidmatrix.operators.cells import vendors
from bidmatrix.schemas import ROW

# Every session's vendors are dealt over so many blocks, which fill in a row's gaps one by one.
VENDOR_BLOCKS = 8


def _provided() -> Column:
    """A vendor provides a service when its amount is above zero."""
    return F.col("amount_cents") > 0


def baseline(cells: DataFrame, keys: list[str] = ROW) -> DataFrame:
    """Mean over the vendors that provide the service, 0 when none does."""
    priced = F.when(_provided(), F.col("amount_cents"))
    sums = cells.groupBy(*keys).agg(F.sum(priced).alias("total"), F.count(priced).alias("n_providers"))
    return sums.select(
        *keys, "n_providers", mean_cents(F.col("total"), F.col("n_providers")).alias("baseline_cents")
    )


def in_blocks(labels: DataFrame) -> DataFrame:
    """The vendors of each session as arrays, dealt over VENDOR_BLOCKS blocks by hash of the label."""
    dealt = labels.select("session_id", "vendor").withColumn("block", _block(F.col("vendor")))
    return dealt.groupBy("session_id", "block").agg(F.collect_list("vendor").alias("vendors"))


def _block(vendor: Column) -> Column:
    return F.pmod(F.hash(vendor), F.lit(VENDOR_BLOCKS))


def service_rows(cells: DataFrame, keys: list[str] = ROW) -> DataFrame:
    """Every row of the matrix once: keys, n_providers, baseline_cents and the ``entries`` (vendor, amount_cents) of its cells."""
    priced = F.when(_provided(), F.col("amount_cents"))
    rows = cells.groupBy(*keys).agg(
        F.sum(priced).alias("total"), F.count(priced).alias("n_providers"),
        F.collect_list(F.struct("vendor", "amount_cents")).alias("entries"),
    )
    return rows.select(*keys, "n_providers", mean_cents(F.col("total"), F.col("n_providers")).alias("baseline_cents"), "entries")


def row_entries(rows: DataFrame, *columns: str) -> DataFrame:
    """The cells of ``service_rows`` again, each with those columns of its row."""
    return rows.select(*columns, F.inline("entries"))


def filled_rows(cells: DataFrame, keys: list[str] = ROW, labels: DataFrame | None = None) -> DataFrame:
    """``fill`` of the cells' rows. ``labels`` are the sessions' vendors where ``cells`` are only some of their rows."""
    return fill(service_rows(cells, keys), vendors(cells) if labels is None else labels, keys)


def fill(rows: DataFrame, labels: DataFrame, keys: list[str] = ROW) -> DataFrame:
    """Every row of the matrix with every vendor of its session, as arrays.

    keys, n_providers, baseline_cents, ``quoted`` (vendor, amount_cents) entries and ``absent``
    vendors, for each block of vendors. A session's vendors always come in up to VENDOR_BLOCKS
    blocks, by hash of the label, whatever their number. Rows and vendors meet as arrays inside a
    row, so the filled-in matrix is never shuffled, and a row's entries arrive with its baseline
    in one shuffle. ``rows`` are ``service_rows``, ``labels`` (session_id, vendor, distinct) their sessions' vendors.
    """
    filled = rows.join(in_blocks(labels), "session_id").withColumn(
        "quoted", F.filter("entries", lambda e: _block(e["vendor"]) == F.col("block"))
    )
    absent = F.array_except("vendors", F.transform("quoted", lambda q: q["vendor"]))
    return filled.select(*keys, "n_providers", "baseline_cents", "quoted", absent.alias("absent"))


def _entries() -> Column:
    quoted = F.transform(
        "quoted",
        lambda q: F.struct(q["vendor"].alias("vendor"), q["amount_cents"].alias("amount_cents"), F.lit(True).alias("quoted")),
    )
    absent = F.transform(
        "absent",
        lambda v: F.struct(v.alias("vendor"), F.lit(0).cast("bigint").alias("amount_cents"), F.lit(False).alias("quoted")),
    )
    return F.concat(quoted, absent)


def comparison_matrix(cells: DataFrame, keys: list[str] = ROW, labels: DataFrame | None = None) -> DataFrame:
    """The full matrix in long form: one row per service and vendor of the session.

    ``quoted`` tells an amount of 0 from a service the vendor does not list.
    """
    return long_matrix(filled_rows(cells, keys, labels), keys)


def long_matrix(filled: DataFrame, keys: list[str] = ROW) -> DataFrame:
    """The matrix in long form from its filled-in rows."""
    long = filled.select(*keys, "n_providers", "baseline_cents", F.explode(_entries()).alias("e"))
    return long.select(*keys, "n_providers", "baseline_cents", "e.vendor", "e.amount_cents", "e.quoted")


def wide_matrix(cells: DataFrame, session_id: str, labels: list[str]) -> DataFrame:
    """One session's matrix with a column per vendor, rows and columns sorted.

    ``labels`` are the vendors to show, normally ``vendor_list`` of that one session.
    """
    session = cells.where(F.col("session_id") == session_id)
    names = sorted(labels)
    pivoted = session.groupBy("service_category", "sub_service").pivot("vendor", names).agg(F.sum("amount_cents"))
    averages = baseline(session, ["service_category", "sub_service"])
    columns = [F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names]
    return (
        pivoted.join(averages, ["service_category", "sub_service"])
        .select("service_category", "sub_service", "baseline_cents", *columns)
        .orderBy("service_category", "sub_service")
    )


def vendor_list(cells: DataFrame) -> DataFrame:
    """The vendor labels of each session, a row each; the label is the sort key."""
    return vendors(cells)


def category_groups(cells: DataFrame) -> DataFrame:
    """The matrix rows of each category, a row each; the sub-service is the sort key."""
    return baseline(cells).drop("n_providers")


def group_order(positioned: DataFrame) -> DataFrame:
    """Categories by first appearance: ``positioned`` rows carry service_category and pos."""
    return positioned.groupBy("session_id", "service_category").agg(F.min("pos").alias("first_pos"))

"""Text lane: quote texts to line items.

Line grammar: ``{sub_service} :: {work_title} :: SAC {code} | {qty} | {rate} | {pricing} | {amount}``.
The three stacked description parts are set apart by `` :: `` because official labels contain
`` / `` themselves. A blank price is 0; numbers may have a sign and thousands commas. Lines of any
other shape (scope, materials, terms) are not table rows; one that looks like a row but does not
read as one is kept apart and sets its quote aside.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidmatrix import schemas
from bidmatrix.functions.money import to_cents
from bidmatrix.sources.landing import Landed, checked, computed_once, defect, land, quote_key

# The shape of a table row, and what tells a damaged one from prose.
_NUMBER = r"([+-]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{2,3})+)(?:\.[0-9]*)?|[+-]?\.[0-9]+|)"
ROW_PATTERN = rf"^(.+?) :: (.*) :: SAC ([0-9]+) \| {_NUMBER} \| {_NUMBER} \| ([^|]*) \| {_NUMBER}\r?$"
ROW_LIKE = r" :: .* :: |(?:\|.*){4}"


def _parts(line: Column) -> Column:
    """The seven parts of a row, from one match; a line holds no line break, so that sets them apart."""
    return F.split(F.regexp_replace(line, ROW_PATTERN, "$1\n$2\n$3\n$4\n$5\n$6\n$7"), "\n")


def _plain(number: Column) -> Column:
    return F.replace(number, F.lit(","), F.lit(""))


def _item(parts: Column) -> Column:
    part = lambda n: F.get(parts, F.lit(n - 1))
    cents = lambda n: F.coalesce(to_cents(_plain(part(n))), F.lit(0).cast("bigint"))
    return F.struct(
        F.lit(schemas.DOCUMENT_DEFAULTS["service_category"]).alias("service_category"),
        part(1).alias("sub_service"), part(2).alias("work_title"), F.concat(F.lit("SAC "), part(3)).alias("description"),
        F.coalesce(_plain(part(4)).try_cast("double"), F.lit(0.0)).alias("quantity"),
        part(6).alias("pricing_method"), cents(5).alias("rate_cents"), cents(7).alias("amount_cents"),
    )


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("*", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_items(texts: DataFrame) -> DataFrame:
    """(quote_id, text) to one row per table line; a missing price is 0."""
    rows = _lines(texts.select("quote_id", "text")).where(F.rlike("line", F.lit(ROW_PATTERN)))
    parts = computed_once(rows, "parts", _parts(F.col("line")))
    items = parts.select("quote_id", "line_no", F.get("parts", F.lit(2)).alias("sac_code"), _item(F.col("parts")).alias("i"))
    return items.select(
        "quote_id", "line_no", "i.sub_service", "i.work_title", "sac_code", "i.quantity", "i.rate_cents", "i.pricing_method",
        "i.amount_cents",
    )


def unparsed_lines(texts: DataFrame) -> DataFrame:
    """Lines that look like table rows and do not read as one."""
    lines = _lines(texts.select("quote_id", "text"))
    return lines.where(F.rlike("line", F.lit(ROW_LIKE)) & ~F.rlike("line", F.lit(ROW_PATTERN))).drop("text")


def documents(texts: DataFrame) -> DataFrame:
    """One row per quote text (session_id, source_filename, vendor_name, text), as of the other lanes.

    A text names no category and no total; its total is the sum of its lines.
    """
    # each line is matched once: a row comes in seven parts, any other line whole
    typed = computed_once(texts, "lines", F.transform(F.split("text", "\n"), _parts))
    is_row = lambda parts: F.size(parts) > 1
    typed = computed_once(typed, "items", F.coalesce(F.transform(F.filter("lines", is_row), _item), F.array()))
    odd = F.exists("lines", lambda parts: ~is_row(parts) & F.rlike(parts[0], F.lit(ROW_LIKE)))
    shaped = typed.select(
        quote_key(F.col("session_id"), F.col("source_filename"), F.sha2("text", 256)).alias("quote_id"),
        "session_id", "vendor_name",
        F.lit(None).cast("string").alias("client_name"), F.lit(None).cast("string").alias("quote_date"),
        F.aggregate("items", F.lit(0).cast("bigint"), lambda acc, i: acc + i["amount_cents"]).alias("grand_total_cents"),
        "source_filename", F.lit("text").alias("source_type"), "items", F.col("text").alias("document"),
        F.coalesce(odd, F.lit(False)).alias("odd"),
    )
    return checked(shaped, defect(F.col("odd"), "unparsed_line"), defect(F.size("items") == 0, "no_lines")).drop("odd")


def extract(texts: DataFrame) -> Landed:
    return land(documents(texts))

"""Quotes, line items and input documents derived from the given tables (see FIXTURES.md).

A session is a customer nation and a block of five suppliers, a vendor is a supplier. Nothing
here carries a broadcast hint: every table may be large, Spark checks sizes itself.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidmatrix.functions.money import amount
from bidmatrix.operators.sittings import micros


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sub_service(p_type: Column, p_size: Column) -> Column:
    return F.concat(p_type, F.lit(" S"), (p_size % 4).cast("string"))


def _description(p_name: Column, p_size: Column) -> Column:
    return F.concat(p_name, F.lit("&nbsp;size "), p_size.cast("string"))


def _pricing_method(p_size: Column) -> Column:
    return F.when(p_size % 2 == 0, "Square Feet").otherwise("Unit")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their order, customer and part.

    Texts that depend on one part are put together once per part; money is whole cents before the joins, which so move less.
    """
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size")
    part = table(spark, sf, "part").select(
        "p_partkey",
        kind.alias("service_category"),
        _sub_service(kind, size).alias("sub_service"),
        name.alias("work_title"),
        _description(name, size).alias("description"),
        _pricing_method(size).alias("pricing_method"),
    )
    return _sold(spark, sf, part)


def _sold(spark: SparkSession, sf: str, part: DataFrame) -> DataFrame:
    """Line items with their order, customer and what is given of their part."""
    t = lambda name: table(spark, sf, name)
    price = F.col("l_extendedprice") * 100
    cents = lambda c: F.round(c).cast("bigint")
    gross = price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    line = t("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus",
        cents(price / F.col("l_quantity")).alias("rate_cents"), cents(price).alias("amount_cents"), cents(gross).alias("gross_cents"),
    )
    # orders meet their customers before the lines, which outnumber them
    sold = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return line.join(sold, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with the texts that depend on them alone."""
    return table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("vendor_name"), *_supplier_texts(F.col("s_suppkey")))


def _supplier_texts(key: Column) -> list[Column]:
    text, block = key.cast("string"), key - key % 5
    return [
        F.concat(F.lit("S"), text, F.lit(".pdf")).alias("source_filename"),
        F.concat(F.lit("_"), block.cast("string")).alias("block"),
        F.concat(F.lit("_"), text).alias("supplier"),
    ]


def _quoted(lines: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Lines, or their sums by nation and supplier, with session, quote and vendor."""
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("*", *_quote_ids())


def _quote_ids() -> list[Column]:
    """Session and quote of a nation and the texts of a supplier."""
    return [
        F.concat(F.lit("session_"), F.col("c_nationkey").cast("string"), "block").alias("session_id"),
        F.concat(F.lit("q"), F.col("c_nationkey").cast("string"), "supplier").alias("quote_id"),
    ]


def _base(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their order, customer, part and supplier."""
    return _quoted(_lines(spark, sf), _suppliers(spark, sf)).withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def _sums(spark: SparkSession, sf: str, by: list[str], sums: list[str], *others: Column) -> DataFrame:
    """Lines summed per quote and the columns ``by`` of their parts: ``sums`` of lines, and the ``others``, which repeats do not change.

    A nation and a supplier's key stand for the quote's texts until the lines are summed. A supplier's row that comes n times
    counts a line n times.
    """
    summed = _lines(spark, sf).groupBy("c_nationkey", "l_suppkey", *by).agg(*[F.sum(c).alias(c) for c in sums], *others)
    suppliers = _suppliers(spark, sf)
    met = _quoted(summed, suppliers.groupBy(*suppliers.columns).agg(F.count(F.lit(1)).alias("n_alike")))
    kept = [c for c in summed.columns if c not in ("c_nationkey", "l_suppkey", *sums)]
    return met.select(*QUOTE, *kept, *[(F.col(c) * F.col("n_alike")).alias(c) for c in sums])


#: What stands for a quote until its lines are put together: its texts follow from these.
_DEALT = ["c_nationkey", "l_suppkey", "vendor_name"]


def _vendors_lines(spark: SparkSession, sf: str, lines: DataFrame) -> DataFrame:
    """Lines with the name of their vendor."""
    supplier = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("vendor_name"))
    return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))


def _named(dealt: DataFrame) -> DataFrame:
    """Rows by _DEALT with the texts of their quote."""
    return dealt.select("*", *_supplier_texts(F.col("l_suppkey"))).select("*", *_quote_ids())


def items(spark: SparkSession, sf: str) -> DataFrame:
    """The joined line-item frame (without the quote's total)."""
    return _base(spark, sf).select(
        "session_id", "quote_id", "vendor_name", "source_filename", "service_category", "sub_service",
        "work_title", "description",
        F.col("l_quantity").alias("quantity"),
        "pricing_method",
        "rate_cents", "amount_cents", "gross_cents", "o_orderdate",
    )


QUOTE = ["session_id", "quote_id", "vendor_name", "source_filename"]


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    first_day = F.min("o_orderdate").alias("first_day")
    return _sums(spark, sf, [], ["gross_cents"], first_day).select(
        *QUOTE, F.col("gross_cents").alias("grand_total_cents"), F.date_format("first_day", "yyyy-MM-dd").alias("quote_date"),
    )


def quotes_of(lines: DataFrame) -> DataFrame:
    """The quotes of joined lines, or of their sums."""
    return lines.groupBy(*QUOTE).agg(
        F.sum("gross_cents").alias("grand_total_cents"),
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("quote_date"),
    )


def quote_sums(spark: SparkSession, sf: str, *detail: str) -> DataFrame:
    """Lines summed per quote, service and ``detail``: what cells, totals and rates can all be taken from in one pass.

    A nation, a supplier's key and the vendor's name stand for the quote's texts until the lines are summed.
    """
    by = [*_DEALT, "service_category", "sub_service", *detail]
    summed = _vendors_lines(spark, sf, _lines(spark, sf)).groupBy(*by).agg(
        F.sum("amount_cents").alias("amount_cents"), F.sum("gross_cents").alias("gross_cents"),
        F.sum("rate_cents").alias("rate_cents"), F.count("rate_cents").alias("n_rates"), F.count(F.lit(1)).alias("n_items"),
        F.min("o_orderdate").alias("o_orderdate"),
    )
    return _named(summed).select(*QUOTE, *[c for c in summed.columns if c not in _DEALT])


def price_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Lines summed per quote and service, without rates: what cells and totals can be taken from in one pass."""
    first_day = F.min("o_orderdate").alias("o_orderdate")
    return _sums(spark, sf, ["service_category", "sub_service"], ["amount_cents", "gross_cents"], first_day)


def dated_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes whose dates are written in one of four ways, one of them no date."""
    day, way = F.col("quote_date").cast("date"), F.col("grand_total_cents") % 4
    written = (
        F.when(way == 0, F.date_format(day, "dd/MM/yyyy")).when(way == 1, F.date_format(day, "d MMM yyyy"))
        .when(way == 2, F.lit("soon")).otherwise(F.col("quote_date"))
    )
    return quotes(spark, sf).withColumn("quote_date", written)


def faulty_quotes(spark: SparkSession, sf: str, given: DataFrame) -> DataFrame:
    """The given quotes, some without vendor, date or total by their total's last digit, and those without lines."""
    fault = F.col("grand_total_cents") % 10
    whole = given.select(
        "session_id", "quote_id", F.when(fault == 0, " ").otherwise(F.col("vendor_name")).alias("vendor_name"),
        F.col("session_id").alias("client_name"), F.when(fault == 1, "").otherwise(F.col("quote_date")).alias("quote_date"),
        F.when(fault != 2, F.col("grand_total_cents")).alias("grand_total_cents"),
    )
    return whole.unionByName(bare_quotes(spark, sf), allowMissingColumns=True)


def _day(column: str) -> Column:
    """Whole days since 1970."""
    return F.unix_date(F.col(column).cast("date")).cast("bigint")


def lines_in_time(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each vendor with the days on which they were ordered and shipped."""
    t = lambda name: table(spark, sf, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pos = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")
    return joined.select(pos, F.col("s_name").alias("vendor_name"), _day("o_orderdate").alias("order_day"), _day("l_shipdate").alias("ship_day"))


def priced_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Session, position and amount of each line."""
    return _base(spark, sf).select("session_id", "pos", "amount_cents")


def quotes_in_time(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes of each vendor with their day."""
    return quotes(spark, sf).select("vendor_name", "quote_id", "grand_total_cents", _day("quote_date").alias("quote_day"))


def bare_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """A quote without any line for each supplier, in a session of its own."""
    key = F.col("s_suppkey").cast("string")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("bare_"), key).alias("session_id"), F.concat(F.lit("bare_q"), key).alias("quote_id"),
        F.col("s_name").alias("vendor_name"), F.lit(0).cast("bigint").alias("grand_total_cents"),
    )


def quote_items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items without the attributes of their quote, as stored."""
    return items(spark, sf).drop("vendor_name", "source_filename", "gross_cents", "o_orderdate")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions spread over the nations' blocks of suppliers; some ask for sessions that do not exist."""
    block = F.expr("conv_id div 25 % 250 * 5").cast("string")
    session = F.concat(F.lit("session_"), (F.col("conv_id") % 25).cast("string"), F.lit("_"), block)
    return table(spark, sf, "conversations").where("role = 'user'").select(
        "conv_id", "turn", session.alias("session_id"), "text"
    )


def quote_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Per quote: its attributes, total and first day, and its ``groups``: each category with its lines.

    Lines are dealt by nation, supplier and vendor's name with the columns of their part, which all texts of a document
    follow from. So a line moves without them, and what both lanes are made of can be stored once.
    """
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_name", "p_size")
    line = F.struct("p_name", "p_size", F.col("l_quantity").alias("quantity"), "rate_cents", "amount_cents")
    per_category = (
        _vendors_lines(spark, sf, _sold(spark, sf, part))
        .select(*_DEALT, "p_type", "p_name", "p_size", "l_quantity", "rate_cents", "amount_cents", "gross_cents", "o_orderdate")
        .repartition(*_DEALT)
        .groupBy(*_DEALT, "p_type")
        .agg(F.collect_list(line).alias("lines"), F.sum("gross_cents").alias("gross"), F.min("o_orderdate").alias("first_day"))
    )
    per_quote = per_category.groupBy(*_DEALT).agg(
        F.collect_list(F.struct(F.col("p_type").alias("service_category"), "lines")).alias("groups"),
        F.sum("gross").alias("total_cents"),
        F.date_format(F.min("first_day"), "yyyy-MM-dd").alias("quote_date"),
    )
    return _named(per_quote).select(*QUOTE, "groups", "total_cents", "quote_date")


def _documents(given: DataFrame, item, service) -> DataFrame:
    """Per quote of ``quote_lists``: its attributes and its services, each with an array of items.

    ``item`` makes one of a line and its texts, ``service`` a service of a category and its items.
    """
    def items_of(group: Column) -> Column:
        kind = group["service_category"]
        return F.transform(group["lines"], lambda line: item({
            "sub_service": _sub_service(kind, line["p_size"]), "work_title": line["p_name"],
            "description": _description(line["p_name"], line["p_size"]), "pricing_method": _pricing_method(line["p_size"]),
            "quantity": line["quantity"], "rate_cents": line["rate_cents"], "amount_cents": line["amount_cents"],
        }))

    services = F.transform("groups", lambda g: service(g["service_category"], items_of(g)))
    return given.withColumn("services", services).drop("groups")


def payloads(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    """Structured pushes. ``given`` is ``quote_lists`` where several inputs are made of it."""
    return _payloads(spark, sf, given).select("session_id", "payload")


def _payloads(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    """Structured pushes, a third of the quotes in each of the three envelopes.

    Rates travel as numbers, amounts and quantities as text.
    """
    text = lambda c: c.cast("string")
    item = lambda line: F.struct(
        line["work_title"].alias("workTitle"),
        line["description"].alias("description"),
        F.struct(line["sub_service"].alias("name")).alias("subService"),
        F.struct(line["pricing_method"].alias("name")).alias("pricingMethod"),
        F.array(F.struct(
            text(line["quantity"]).alias("quantity"),
            amount(line["rate_cents"]).alias("rate"),
            text(amount(line["amount_cents"])).alias("grandTotal"),
        )).alias("pricingInput"),
    )
    service = lambda category, items: F.struct(F.struct(category.alias("name")).alias("serviceId"), items.alias("workItems"))
    docs = _documents(quote_lists(spark, sf) if given is None else given, item, service)
    line = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    total = text(amount(F.col("total_cents")))
    body = F.to_json(F.struct(
        F.col("source_filename").alias("quoteNumber"),
        F.struct(F.col("vendor_name").alias("companyName")).alias("vendorDetail"),
        F.array(line("Sub Total", F.lit("1.00")), line("Grand Total (incl. GST)", total)).alias("pricingSummary"),
        F.array(F.struct("services")).alias("workSummary"),
    ))
    envelope = F.crc32("quote_id") % 3
    payload = (
        F.when(envelope == 0, body)
        .when(envelope == 1, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(F.concat(F.lit('{"quotes":['), body, F.lit("]}")))
    )
    return docs.select("session_id", "total_cents", body.alias("body"), payload.alias("payload"))


def extracted(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    """Extracted quote documents; quotes with an even total come without a session. ``given`` as for ``payloads``."""
    item = lambda line: F.struct(
        *[line[c].alias(c) for c in ("sub_service", "work_title", "description", "quantity", "pricing_method")],
        amount(line["rate_cents"]).alias("rate"), amount(line["amount_cents"]).alias("amount"),
    )
    service = lambda category, items: F.struct(category.alias("service_category"), items.alias("items"))
    docs = _documents(quote_lists(spark, sf) if given is None else given, item, service)
    body = F.to_json(F.struct(
        "vendor_name", F.col("session_id").alias("client_name"), "quote_date",
        amount(F.col("total_cents")).alias("grand_total"), "services",
    ))
    return docs.select(
        F.col("quote_id").alias("request_id"),
        F.when(F.col("total_cents") % 2 == 0, F.lit(None)).otherwise(F.col("session_id")).alias("session_id"),
        F.concat(F.lit("/quotes/"), "session_id", F.lit("/"), "source_filename").alias("path"),
        body.alias("json"),
    )


def damaged_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The pushes with faults, by the quote's total: a null vendor, an unreadable rate, a broken document,
    a number beside a good quote, no list of quotes, an object for a list of prices, a text for a list of works."""
    damage = F.col("total_cents") % 8
    return _payloads(spark, sf).select(
        "session_id",
        F.when(damage == 3, F.concat(F.lit('{"quotes":['), "body", F.lit(",5]}")))
        .when(damage == 4, F.lit('{"quotes":null}'))
        .when(damage == 5, F.regexp_replace("payload", r'"pricingInput":\[(\{[^}]*\})\]', '"pricingInput":$1'))
        .when(damage == 6, F.regexp_replace("body", r'"workSummary":.*$', '"workSummary":"none"}'))
        .when(damage == 0, F.regexp_replace("payload", r'"vendorDetail":\{[^}]*\}', '"vendorDetail":null'))
        .when(damage == 1, F.regexp_replace("payload", r'"rate":[0-9.]+', '"rate":"n/a"'))
        .when(damage == 2, F.concat(F.lit("{"), "payload"))
        .otherwise(F.col("payload")).alias("payload"),
    )


def quote_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes as text: a prose line, one line per item, a terms line.

    Quantity 1 leaves the amount blank, 2 is written in a way that does not read, 3 has a bar in its title,
    and from 40 on amounts have thousands commas.
    """
    money = lambda c: amount(F.col(c)).cast("string")
    line = F.concat(
        "sub_service", F.lit(" :: "), "work_title", F.when(F.col("quantity") == 3, " | deluxe").otherwise(""), F.lit(" :: SAC "),
        F.regexp_extract("description", r"size (\d+)", 1), F.lit(" | "),
        F.when(F.col("quantity") == 2, "1.5.2").otherwise(F.col("quantity").cast("string")), F.lit(" | "), money("rate_cents"), F.lit(" | "), "pricing_method", F.lit(" | "),
        F.when(F.col("quantity") == 1, F.lit(""))
        .when(F.col("quantity") >= 40, F.format_number(amount(F.col("amount_cents")), 2)).otherwise(money("amount_cents")),
    )
    quote = ["session_id", "quote_id", "vendor_name", "source_filename"]
    lines = items(spark, sf).repartition("quote_id").groupBy(*quote).agg(F.collect_list(line).alias("lines"))
    text = F.concat(
        F.lit("Scope of Work: supply and fit | all rooms\n"), F.array_join("lines", "\n"),
        F.lit("\nTerms & Conditions: 50 % advance | balance on completion"),
    )
    return lines.select(*quote, text.alias("text"))


def taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Word bank for the derived labels: all but those ending in S3, plus two nobody quotes."""
    used = items(spark, sf).select("service_category", "sub_service").distinct().where("not endswith(sub_service, 'S3')")
    extra = spark.createDataFrame(
        [("ECONOMY", "ECONOMY S9"), ("SPARE", "SPARE S0")], "service_category string, sub_service string"
    )
    return used.unionByName(extra)


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where each category turns up in its session's list of lines."""
    return _base(spark, sf).select("session_id", "service_category", "pos")


def files(spark: SparkSession, sf: str, status: str) -> DataFrame:
    """File selections with many repeats: one per line item of the given line status."""
    return _base(spark, sf).where(F.col("l_linestatus") == status).select(
        "session_id",
        F.col("source_filename").alias("name"),
        F.col("l_quantity").cast("bigint").alias("size"),
        "pos",
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their time in microseconds and their value in cents."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf, "events").withColumns({"at": micros("ts"), "cents": cents, "day": F.date_format("ts", "yyyy-MM-dd")})


#: Days of events that arrive together, and by how many at most an event comes after its period.
PERIOD_DAYS, LATE_DAYS = 5, 1


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Events by the period they arrive in: up to a day late, by their id, every seventh again a period later."""
    day = 86_400_000_000
    late = F.pmod(F.xxhash64("event_id"), F.lit(LATE_DAYS * day))
    first = events(spark, sf).withColumn("period", F.floor((F.col("at") + late) / (PERIOD_DAYS * day)))
    again = first.where("event_id % 7 = 0").withColumn("period", F.col("period") + 1)
    return first.unionByName(again).withColumn("ts", F.col("ts").cast("timestamp"))


def part_names(spark: SparkSession, sf: str) -> DataFrame:
    """A name of its own for every part, with its category and key."""
    name = F.concat("p_name", F.lit(" "), F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 6))
    return table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("service_category"), name.alias("sub_service"))


def misspelt(spark: SparkSession, sf: str) -> DataFrame:
    """The parts' names with a letter left out, others put in or in capitals; every fifth under a category that no bank knows."""
    key, name = F.col("p_partkey"), F.col("sub_service")
    written = (
        F.when(key % 4 == 1, F.concat(F.substring(name, 1, 2), F.substring(name, 4, 100)))
        .when(key % 4 == 2, F.concat(F.substring(name, 1, 1), F.lit("x"), F.substring(name, 3, 100), F.lit("y")))
        .when(key % 4 == 3, F.upper(name)).otherwise(name)
    )
    category = F.when(key % 5 == 0, "UNKNOWN").otherwise(F.col("service_category"))
    return part_names(spark, sf).select(category.alias("service_category"), written.alias("sub_service"))

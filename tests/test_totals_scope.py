"""Totals, ranks, scope and session state."""

import random
from datetime import datetime
from itertools import product

from pyspark.sql import functions as F

from bidmatrix.operators import cells as c
from bidmatrix.operators import conformance, matrix, salting, scope, totals, usage
from bidmatrix.plans import comparison, sessions
from bidmatrix.sources import files, quotetext, taxonomy
from conftest import rows
from workload import views

QUOTE = "session_id string, quote_id string, vendor_name string, source_filename string, quote_date string, grand_total_cents bigint"


def quotes_of(spark, data):
    return spark.createDataFrame(data, QUOTE)


def lines_of(spark, ids):
    return spark.createDataFrame([(s, q, 1) for s, q in ids], "session_id string, quote_id string, amount_cents bigint")


def test_same_label_twice(spark):
    quotes = quotes_of(spark, [
        ("s", "1", "A", "f", "", 10), ("s", "2", "A", "f", "", 20), ("s", "3", "A", "f", "", 20),
        ("s", "4", "B", "f", "", None), ("s", "5", "C", "f", "", 1), ("s", "6", None, "f", "", 3),
    ])
    items = lines_of(spark, [("s", q) for q in "12346"] + [("s", "gone")])
    assert rows(totals.vendor_totals(quotes, items), "vendor", "total_cents") == [
        ("A (f)", 10), ("A (f)", 20), ("B (f)", 0), (None, 3)]
    assert ("B (f)", None) in rows(totals.raw_totals(quotes, items), "vendor", "grand_total_cents")
    assert rows(sessions.orphan_quotes(quotes, items), "quote_id") == [("5",)]


def test_session_state(spark):
    quotes = quotes_of(spark, [("a", "1", "A", "f", "", 1), ("a", "2", "B", "f", "", 1), ("b", "3", "A", "f", "", 1)])
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "session_id string")
    got = rows(sessions.session_status(asked, quotes, lines_of(spark, [("a", "1"), ("a", "1")])), "session_id", "n_quotes", "n_items", "status")
    assert got == [("a", 2, 2, "ok"), ("b", 1, 0, "no_items"), ("c", 0, 0, "no_quotes")]
    assert rows(sessions.comparable_sessions(quotes), "session_id") == [("a",)]


def test_rank_matches_plain_ranking(spark):
    rng = random.Random(1)
    data = [("hot", f"v{i}", rng.choice([0, 7, rng.randrange(10**9), -rng.randrange(10**6), rng.randrange(99_990, 100_020)])) for i in range(800)]
    data += [("cold", f"w{i}", rng.randrange(5)) for i in range(9)]
    bars = spark.createDataFrame(data, "session_id string, vendor string, total_cents bigint")
    for r in totals.vendor_rank(bars).collect():
        peers = [t for s, _, t in data if s == r.session_id]
        assert r["rank"] == 1 + sum(t < r.total_cents for t in peers)
        assert r.dense_rank == 1 + len({t for t in peers if t < r.total_cents})


def test_scope_against_brute_force(frame):
    rng = random.Random(3)
    data = [(s, v, f"c{x % 4}", f"x{x}", rng.choice([0, -3, 5, 80, 1200])) for s in "st" for v in "ABCD" for x in range(15) if rng.random() < 0.7]
    cells = c.cells(frame(data))
    amount = {(r.session_id, r.service_category, r.sub_service, r.vendor): r.amount_cents for r in cells.collect()}
    for session in "st":
        vendors = sorted({k[3] for k in amount if k[0] == session})
        services = {k[1:3] for k in amount if k[0] == session}
        provides = {s: [v for v in vendors if amount.get((session, *s, v), 0) > 0] for s in services}
        base = {s: (2 * sum(amount[(session, *s, v)] for v in p) + len(p)) // (2 * len(p)) for s, p in provides.items() if p}
        mine = F.col("session_id") == session
        key = ("service_category", "sub_service")
        assert rows(scope.common_scope(cells).where(mine), *key) == sorted(s for s, p in provides.items() if len(p) == len(vendors))
        assert rows(scope.overlap_services(cells).where(mine), *key) == sorted(s for s, p in provides.items() if len(p) > 1)
        assert rows(scope.extra_scope(cells).where(mine), *key, "vendor") == sorted((*s, p[0]) for s, p in provides.items() if len(p) == 1)
        gaps = sorted((*s, v) for s, p in provides.items() if p for v in vendors if v not in p)
        assert rows(scope.scope_gaps(cells).where(mine), *key, "vendor") == gaps
        for r in scope.gap_adjusted_totals(cells).where(mine).collect():
            missing = sum(base[g[:2]] for g in gaps if g[2] == r.vendor)
            total = sum(v for k, v in amount.items() if k[0] == session and k[3] == r.vendor)
            assert (r.total_cents, r.missing_cents, r.adjusted_cents) == (total, missing, total + missing)
        pairs = scope.extreme_pairs(cells.where(mine).groupBy("session_id", "vendor").agg(F.sum("amount_cents").alias("total_cents")))
        a, b = pairs.first().vendor_a, pairs.first().vendor_b
        assert rows(scope.scope_intersect(cells, pairs), *key) == sorted(s for s, p in provides.items() if a in p and b in p)
        assert rows(scope.scope_except(cells, pairs), *key) == sorted(s for s, p in provides.items() if b in p and a not in p)


def test_missing_category(frame):
    cells = c.cells(frame([("s", "A", "Painting", "x", 5), ("s", "A", "Civil", "y", 5), ("s", "B", "Civil", "y", 4), ("s", "B", "Painting", "x", 0)]))
    assert rows(scope.missing_categories(cells), "service_category", "vendor") == [("Painting", "B (B.pdf)")]


def test_top_services_ties_and_nulls(frame):
    data = [("s", "A", "c", f"x{i:02d}", 1) for i in range(25)] + [("s", "A", "d", "x24", 1)] + [("s", "A", "c", None, 1)] * 3
    lines = usage.service_lines(frame(data), "vendor", "description")
    top = rows(usage.top_services(lines), "sub_service", "n", "place")
    assert len(top) == 20 and top[-1] == ("x24", 2, 1) and top[0] == ("x00", 1, 2)
    assert rows(usage.top_services(lines, 1), "sub_service") == [("x24",)]


def test_mean_rate_counts_zeros_not_nulls(frame):
    data = [("s", "A", "c", "x", 1, r, t) for r, t in ((0, "a"), (5, "a"), (None, None), (None, None))]
    lines = usage.service_lines(frame(data + [("s", "B", "c", "x", 1, None, "b")]), "vendor", "description")
    assert rows(usage.rate_means(lines), "vendor", "mean_rate_cents") == [("A (A.pdf)", 3), ("B (B.pdf)", None)]
    assert rows(usage.item_specs(lines), "vendor", "description") == [("A (A.pdf)", "a"), ("A (A.pdf)", None), ("B (B.pdf)", "b")]


def test_bundle_keeps_texts_intact(spark, frame):
    items = frame([("s", 'Finance "N"', "Plumbing Services", "Plumbing Maintenance", 1050), ("s", "B", "Plumbing Services", "Leakage", 200)])
    cells = c.cells(items)
    bars = cells.groupBy("session_id", "vendor").agg(F.sum("amount_cents").alias("total_cents"))
    import json

    entries = comparison.bundle(cells, bars, comparison.rule_summary(cells, bars)).orderBy("section", "sort_number", "sort_text").collect()
    got = {}
    for r in entries:
        got.setdefault(r.section, []).append(r.entry)
    label = 'Finance "N" (Finance "N".pdf)'
    assert got["vendors"] == ["B (B.pdf)", label]
    assert [json.loads(e) for e in got["chartData"]] == [{"vendor": "B (B.pdf)", "total": 2.0}, {"vendor": label, "total": 10.5}]
    fixed = {"category": "Plumbing Services", "sub_service": "Plumbing Maintenance", "market_average": 10.5}
    assert [json.loads(e) for e in got["tableData"][2:]] == [{**fixed, "vendor": "B (B.pdf)", "amount": 0.0}, {**fixed, "vendor": label, "amount": 10.5}]
    assert len(got["report"]) == 1 and got["report"][0].startswith("Lowest total: B (B.pdf) at ₹2.")


def test_every_question_gets_an_answer(spark):
    questions = spark.createDataFrame(
        [(1, 0, "s", "why?"), (2, 0, "s", "  "), (3, 0, "", "x"), (4, 0, "big", "y"), (5, 0, "none", "z")],
        "conv_id bigint, turn bigint, session_id string, text string")
    context = spark.createDataFrame([("s", "{}"), ("big", "a"), ("big", "b")], "session_id string, entry string")
    assert rows(comparison.chat_prompts(questions, context), "conv_id", "n_entries", "error") == [
        (1, 1, None), (4, 2, None), (5, 0, comparison.NO_DATA)]


def test_hot_session_is_spread(spark, frame):
    """A session with most of the rows meets its aggregate in many tasks, none with more than a bounded share."""
    rows_ = spark.range(8_000).select(F.when(F.col("id") < 6_000, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("session_id"),
                                      F.col("id").cast("string").alias("x"))
    per = rows_.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = salting.with_session(rows_, per, ["x"]).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("task").count().collect()]
        assert sum(sizes) == 8_000 and max(sizes) < 8_000 / 4
        assert joined.where("session_id = 'hot'").agg(F.min("n"), F.max("n")).first() == (6_000, 6_000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_price_trend(spark):
    quotes = quotes_of(spark, [("s", "1", "A", "f", "2024-01-02", 10), ("t", "2", "A", "f", "2024-01-02", 15),
                               ("s", "3", "A", "f", "2024-02-01", 11), ("s", "4", "A", "f", "soon", 9), ("s", "5", "A", "f", None, 9)])
    assert rows(totals.price_trend(quotes), "quote_date", "n_quotes", "mean_cents", "change_cents") == [
        ("2024-01-02", 2, 13, None), ("2024-02-01", 1, 11, -2), (None, 2, 9, None)]
    other = quotes_of(spark, [("s", str(i), "A", "f", d, 10) for i, d in enumerate(
        ["2024-03-02", "02/03/2024", "02.03.2024", "02-03-2024", "2 Mar 2024", "Mar 2, 2024", "2 March 2024"])])
    assert rows(totals.price_trend(other), "quote_date", "n_quotes") == [("2024-03-02", 7)]


def test_official_word_bank(spark):
    bank = taxonomy.official(spark)
    assert bank.count() == 137 and bank.select("service_category").distinct().count() == 11
    used = spark.createDataFrame(
        [("Painting", "interior  painting"), ("Painting", "Texture Painting"), ("Interiors", "Modular Kitchn"), ("Roof", "Tiles")],
        "service_category string, sub_service string")
    assert rows(conformance.violations(used, bank), "sub_service") == [("Modular Kitchn",), ("Tiles",), ("interior  painting",)]
    assert rows(conformance.snap(used, bank), "sub_service", "snapped") == [
        ("Modular Kitchn", "Modular Kitchen"), ("Texture Painting", "Texture Painting"), ("Tiles", None), ("interior  painting", "Interior Painting")]
    cells = used.withColumn("session_id", F.lit("s"))
    assert conformance.uncovered(cells, bank).count() == 136


def test_field_problems(spark):
    df = spark.createDataFrame([("c", " ", "Unit", 1.0, 1, None), ("c", "x", "Unit", 1.0, 1, 1)],
                               "service_category string, sub_service string, pricing_method string, quantity double, rate_cents bigint, amount_cents bigint")
    assert [r.problems for r in conformance.field_problems(df).collect()] == [["sub_service", "amount_cents"], []]


def test_text_rows(spark):
    text = "\n".join([
        "Scope of Work: paint | all rooms",
        "Foundation (Isolated / Raft / Pile) :: Block A :: SAC 9954 | 2 | 10.50 | Square Feet | 21.00\r",
        "Lintel ::  :: SAC 9954 |  |  | Unit | ",
        "Terms & Conditions :: none",
    ])
    got = rows(quotetext.line_items(spark.createDataFrame([("q", text)], "quote_id string, text string")),
               "sub_service", "work_title", "sac_code", "quantity", "rate_cents", "pricing_method", "amount_cents")
    assert got == [("Foundation (Isolated / Raft / Pile)", "Block A", "9954", 2.0, 1050, "Square Feet", 2100),
                   ("Lintel", "", "9954", 0.0, 0, "Unit", 0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1")
    assert rows(files.inventory(spark, str(tmp_path)), "name", "length") == [("a.pdf", 5)]
    schema = "session_id string, name string, size bigint, pos bigint"
    chosen = spark.createDataFrame([("s", "a", 1, 0), ("s", "b", 1, 1)], schema)
    added = spark.createDataFrame([("s", "a", 1, 0), ("s", "a", 2, 1), ("s", "a", 2, 2)], schema)
    assert rows(files.add_files(chosen, added), "name", "size", "batch", "pos") == [("a", 1, 0, 0), ("a", 2, 1, 1), ("b", 1, 0, 1)]


def test_summary_sums_come_with_the_rows(spark, frame):
    """The sums behind the summary equal those of vendor_scope, and no cell is joined with its row's baseline."""
    cells = c.cells(frame([
        ("s", "A", "C", "x", 100), ("s", "B", "C", "x", 301), ("s", "A", "C", "y", 50), ("s", "C", "C", "x", 0), ("s", "C", "C", "z", -5),
        ("s", "B", "D", "x", None), ("t", "A", "C", "x", 7), (None, "A", "C", "x", 7), ("t", None, "C", "x", 7), ("u", "A", "C", "x", 0),
    ]))
    columns = ["session_id", "vendor", "shared_cents", "shared_baseline_cents", "n_provided", "n_missing"]
    assert rows(scope.shared_scope(matrix.service_rows(cells)), *columns) == rows(scope.vendor_scope(cells), *columns)
    bars = spark.createDataFrame([("s", "A", 5)], "session_id string, vendor string, total_cents bigint")
    text = comparison.rule_summary(cells, bars)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in text.splitlines() if "Join" in line and "sub_service" in line]


def test_sums_meet_suppliers_after_they_are_summed(spark, tmp_path):
    """Repeated, unnamed and unknown suppliers, parts and nations: the same as summing the joined lines, from fewer rows."""
    tables = {
        "customer": ("c_custkey bigint, c_nationkey int", [(1, 3), (2, None), (2, None)]),
        "orders": ("o_orderkey bigint, o_custkey bigint, o_orderdate timestamp", [
            (1, 1, datetime(2020, 1, 2)), (2, 2, datetime(2020, 1, 1)), (3, 1, None), (3, 1, None), (None, 1, datetime(2020, 1, 3))]),
        "part": ("p_partkey bigint, p_name string, p_type string, p_size int", [(1, "n", "T", 5), (1, "n", "T", 5), (2, "n", None, 6), (3, None, "T", None)]),
        "supplier": ("s_suppkey bigint, s_name string", [(1, "A"), (1, "A"), (1, "B"), (7, None), (None, "C")]),
        "lineitem": (
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_linestatus string",
            [(o, p, s, n, 2.0, price, 0.1, 0.05, "O") for n, (o, p, s) in enumerate(product((1, 2, 3, None), (1, 2, 3, 9), (1, 7, 8, None)))
             for price in (10.01, 0.33, None)]),
    }
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    items = views.items(spark, str(tmp_path))
    by = [*views.QUOTE, "service_category", "sub_service"]
    wanted = items.groupBy(*by).agg(
        F.sum("amount_cents").alias("amount_cents"), F.sum("gross_cents").alias("gross_cents"), F.min("o_orderdate").alias("o_orderdate"))
    columns = [*by, "amount_cents", "gross_cents", "o_orderdate"]
    sums = views.price_sums(spark, str(tmp_path))
    assert rows(sums, *columns) == rows(wanted, *columns) and wanted.count() > 8
    quotes = views.quotes(spark, str(tmp_path))
    assert rows(quotes, *quotes.columns) == rows(views.quotes_of(items), *quotes.columns)
    bars = ["session_id", "vendor", "total_cents"]
    assert rows(totals.totals_of_sums(quotes), *bars) == rows(totals.vendor_totals(quotes, items), *bars)
    # the lines are summed below the join with suppliers
    text = quotes._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join Inner, (l_suppkey") < text.index("sum(gross_cents")

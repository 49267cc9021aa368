"""Cells, baseline and matrix on small frames."""

import json
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidmatrix.functions import display, money
from bidmatrix.operators import cells as c
from bidmatrix.operators import deviation, matrix
from bidmatrix.plans import comparison
from conftest import rows

CELL = ["service_category", "sub_service", "vendor", "amount_cents"]


def test_null_keys_form_no_cell(frame):
    items = frame([
        ("s", "A", None, "x", 1), ("s", "A", "c", None, 2), ("s", None, "c", "x", 3), (None, "A", "c", "x", 4),
        ("s", "A", "c", "x", 5),
    ])
    assert rows(c.cells(items), *CELL) == [("c", "x", "A (A.pdf)", 5)]


def test_null_file_drops_the_label(spark, frame):
    items = frame([("s", "A", "c", "x", 1)]).withColumn("source_filename", F.lit(None).cast("string"))
    assert c.cells(items).count() == 0


def test_group_without_amount_is_zero(frame):
    items = frame([("s", "A", "c", "x", None), ("s", "A", "c", "x", None), ("s", "B", "c", "x", 7), ("s", "B", "c", "x", None)])
    assert rows(c.cells(items), "vendor", "amount_cents") == [("A (A.pdf)", 0), ("B (B.pdf)", 7)]


def test_baseline_over_positive_vendor_sums(frame):
    items = frame([
        ("s", "A", "c", "x", 100), ("s", "A", "c", "x", 100), ("s", "B", "c", "x", 101), ("s", "C", "c", "x", 0),
        ("s", "D", "c", "x", -50), ("s", "C", "c", "y", 0),
    ])
    got = rows(matrix.baseline(c.cells(items)), "sub_service", "n_providers", "baseline_cents")
    # (200 + 101) / 2 = 150.5 rounds up; nobody provides y
    assert got == [("x", 2, 151), ("y", 0, 0)]


def test_half_up_is_exact_and_signed(spark):
    df = spark.createDataFrame([(5, 2), (-5, 2), (535, 200), (7, 3), (0, 4), (1, 0)], "t bigint, n bigint")
    assert [r[0] for r in df.select(money.half_up(F.col("t"), F.col("n"))).collect()] == [3, -3, 3, 2, 0, None]


def test_cents_of_text_and_double(spark):
    df = spark.createDataFrame([("12.345",), ("1e3",), ("abc",), (None,), ("NaN",)], "a string")
    assert [r[0] for r in df.select(money.to_cents(F.col("a"))).collect()] == [1235, 100000, None, None, None]
    nan = spark.createDataFrame([(float("nan"),), (2.675,)], "a double")
    assert [r[0] for r in nan.select(money.to_cents(F.col("a"))).collect()] == [None, 268]


def test_matrix_tells_zero_from_absent(frame):
    items = frame([("s", "A", "c", "x", 0), ("s", "B", "c", "x", 9), ("s", "B", "c", "y", 4)])
    long = matrix.comparison_matrix(c.cells(items))
    assert rows(long, "sub_service", "vendor", "amount_cents", "quoted") == [
        ("x", "A (A.pdf)", 0, True), ("x", "B (B.pdf)", 9, True), ("y", "A (A.pdf)", 0, False), ("y", "B (B.pdf)", 4, True),
    ]


def many(n_vendors, n_services, session="s"):
    """A sparse session: vendor v quotes service x unless (v + x) is a multiple of three."""
    return [
        (session, f"V{v:03d}", f"c{x % 3}", f"x{x:03d}", 100 + v + x)
        for v in range(n_vendors) for x in range(n_services) if (v + x) % 3
    ]


def test_wide_sessions_lose_nothing(frame):
    items = frame(many(30, 12) + many(3, 4, "small"))
    cells = c.cells(items)
    long = matrix.comparison_matrix(cells)
    got = {(r.session_id, r.sub_service, r.vendor): (r.amount_cents, r.quoted, r.baseline_cents) for r in long.collect()}
    want = {}
    for session, vendors, services in (("s", 30, 12), ("small", 3, 4)):
        for x in range(services):
            prices = [100 + v + x for v in range(vendors) if (v + x) % 3]
            mean = (2 * sum(prices) + len(prices)) // (2 * len(prices))
            for v in range(vendors):
                label = f"V{v:03d} (V{v:03d}.pdf)"
                given_ = (v + x) % 3 != 0
                want[(session, f"x{x:03d}", label)] = (100 + v + x if given_ else 0, given_, mean)
    assert got == want
    assert long.count() == len(want)


def test_one_grain_whatever_the_size(spark):
    """A session of 50,000 vendors and one of three: same columns, same rules, everything in order."""
    one = spark.range(50_000).select(F.lit("wide").alias("session_id"), F.format_string("V%05d", F.col("id")).alias("vendor"),
                                     (F.col("id") % 7).alias("amount_cents"))
    other = spark.range(3).select(F.lit("small").alias("session_id"), F.format_string("V%05d", F.col("id")).alias("vendor"),
                                  (F.col("id") + 1).alias("amount_cents"))
    cells = one.unionByName(other).select(
        "session_id", F.lit("c").alias("service_category"), F.lit("x").alias("sub_service"), "vendor", "amount_cents"
    ).unionByName(spark.createDataFrame(
        [("wide", "c", "y", "V00001", 5), ("small", "c", "y", "V00001", 5)],
        "session_id string, service_category string, sub_service string, vendor string, amount_cents bigint"))
    n = {"wide": 50_000, "small": 3}
    bars = cells.groupBy("session_id", "vendor").agg(F.sum("amount_cents").alias("total_cents"))
    entries = comparison.bundle(cells, bars, spark.createDataFrame([("wide", "r"), ("small", "r")], "session_id string, summary string"))
    counts = {(r[0], r[1]): r[2] for r in entries.groupBy("session_id", "section").count().collect()}
    for session, vendors in n.items():
        assert counts[(session, "tableData")] == 2 * vendors and counts[(session, "report")] == 1
        assert counts[(session, "chartData")] == counts[(session, "vendors")] == vendors
    placed = entries.where("session_id = 'wide' and section = 'chartData'").orderBy("sort_number", "sort_text").select("entry").collect()
    totals = [json.loads(r.entry) for r in placed]
    assert [(b["total"], b["vendor"]) for b in totals] == sorted((b["total"], b["vendor"]) for b in totals)
    assert rows(matrix.vendor_list(cells).groupBy("session_id").count(), "session_id", "count") == [("small", 3), ("wide", 50_000)]
    assert rows(matrix.category_groups(cells), "session_id", "sub_service", "baseline_cents") == [
        ("small", "x", 2), ("small", "y", 5), ("wide", "x", 3), ("wide", "y", 5)]


def test_wide_matrix_of_one_session(frame):
    items = frame([("s", "A", "c", "x", 5), ("s", "B", "c", "y", 7), ("t", "A", "c", "z", 1)])
    cells = c.cells(items)
    labels = sorted(r.vendor for r in matrix.vendor_list(cells.where("session_id = 's'")).collect())
    assert labels == ["A (A.pdf)", "B (B.pdf)"]
    wide = matrix.wide_matrix(cells, "s", labels)
    assert wide.columns[3:] == labels
    assert [tuple(r) for r in wide.collect()] == [("c", "x", 5, 5, 0), ("c", "y", 7, 0, 7)]


def test_eager_sum_equals_plain_join(spark, frame):
    items = frame(many(5, 9) + [("s", "V000", "c0", "x001", None)])
    quotes = items.select("session_id", "quote_id", "vendor_name", "source_filename").distinct().withColumn(
        "quote_date", F.lit("")).withColumn("grand_total_cents", F.lit(1).cast("bigint"))
    lines = items.drop("vendor_name", "source_filename")
    assert rows(c.cells_of_tables(lines, quotes), *CELL) == rows(c.cells(items), *CELL)
    assert rows(c.cells(c.join_quotes(lines, quotes)), *CELL) == rows(c.cells(items), *CELL)


def test_display(spark):
    df = spark.createDataFrame([(0,), (123456789,), (150,), (1_250_000_00,), (-5,)], "c bigint")
    got = [tuple(r) for r in df.select(display.price_or_na(F.col("c")), display.lakhs(F.col("c"))).collect()]
    assert got == [("N/A", "₹0.0L"), ("₹1,234,567.89", "₹12.3L"), ("₹1.5", "₹0.0L"), ("₹1,250,000", "₹12.5L"), ("₹-0.05", "₹0.0L")]


def test_deviation_and_flags(frame):
    cells = c.cells(frame([("s", "A", "c", "x", 50), ("s", "B", "c", "x", 150), ("s", "C", "c", "x", 100), ("s", "A", "c", "y", 9)]))
    got = rows(deviation.deviation(cells), "sub_service", "vendor", "deviation_cents", "deviation_pct", "position")
    assert got == [("x", "A (A.pdf)", -50, -50.0, "below"), ("x", "B (B.pdf)", 50, 50.0, "above"),
                   ("x", "C (C.pdf)", 0, 0.0, "at"), ("y", "A (A.pdf)", 0, 0.0, "at")]
    assert rows(deviation.red_flags(cells, 50), "vendor") == [("A (A.pdf)",), ("B (B.pdf)",)]


VALUE = st.one_of(st.none(), st.integers(-5_000, 1_000_000), st.just(0))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(
    st.sampled_from(["s", "t", None]), st.sampled_from(["A", "B", "C", None]), st.sampled_from(["c", "d", None]),
    st.sampled_from(["x", "y", None]), VALUE), min_size=1, max_size=40))
def test_model_of_cells_and_baseline(frame, data):
    sums = {}
    for session, vendor, cat, sub, amount in data:
        if None not in (session, vendor, cat, sub):
            key = (session, cat, sub, f"{vendor} ({vendor}.pdf)")
            sums[key] = sums.get(key, 0) + (amount or 0)
    cells = c.cells(frame(data))
    assert {tuple(r)[:4]: r.amount_cents for r in cells.collect()} == sums
    base = {(r.session_id, r.service_category, r.sub_service): r.baseline_cents for r in matrix.baseline(cells).collect()}
    for key, got in base.items():
        prices = [v for k, v in sums.items() if k[:3] == key and v > 0]
        assert abs(got - (statistics.fmean(prices) if prices else 0)) <= 0.5
    dense = matrix.comparison_matrix(cells).collect()
    vendors = {s: {k[3] for k in sums if k[0] == s} for s in {k[0] for k in sums}}
    assert len(dense) == sum(len(vendors[k[0]]) for k in {k[:3] for k in sums})
    assert sum(r.amount_cents for r in dense) == sum(sums.values())

"""What steps leave on disk, and the documents of both lanes made of one stored table."""

import glob
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bidmatrix.plans import comparison
from bidmatrix.session import stored
from bidmatrix.sources.store import QuoteStore
from bidmatrix.streaming import sync
from conftest import rows
from test_intake import PAYLOAD, quote
from workload import queries, views


def shuffle_files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")


@pytest.fixture
def tables(spark, tmp_path):
    """Two suppliers of one key, a line without customer, a part without size, one without name."""
    def table(name, columns, *given):
        spark.createDataFrame(given, columns).write.parquet(str(tmp_path / f"{name}.parquet"))

    table("customer", "c_custkey bigint, c_name string, c_nationkey int", (1, "c", 3), (2, "d", None))
    table("supplier", "s_suppkey bigint, s_name string, s_nationkey int", (6, "V", 1), (7, "W", 1), (7, "W", 1), (8, None, 1))
    table("part", "p_partkey bigint, p_name string, p_type string, p_size int",
          (1, "red bolt", "LARGE", 6), (2, "hot rod", "SMALL", None), (3, None, "SMALL", 5), (4, "old ring", None, 2))
    table("orders", "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp", *[(o, 1 + o % 2, datetime(2000, 1, o)) for o in range(1, 9)])
    lines = [(o, p, s, 1, q, 100.0 * q, 0.0, 0.1, "O") for o, p, s, q in [
        (2, 1, 6, 1.0), (4, 2, 6, 2.0), (4, 1, 6, 3.0), (6, 3, 7, 4.0), (8, 4, 7, 5.0), (8, 1, 7, 6.0), (3, 1, 6, 7.0), (2, 1, 8, 8.0), (9, 1, 6, 9.0)]]
    table("lineitem", "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
          "l_extendedprice double, l_discount double, l_tax double, l_linestatus string", *lines)
    return str(tmp_path)


def test_documents_hold_every_line(spark, tables):
    joined = rows(views.items(spark, tables), "session_id", "source_filename", "service_category", "sub_service", "work_title", "description", "quantity", "pricing_method", "amount_cents")
    found = []
    for r in stored(views.quote_lists(spark, tables)).collect():
        assert r.total_cents == sum(x["gross_cents"] for x in views.items(spark, tables).where(
            (F.col("source_filename") == r.source_filename) & F.col("session_id").eqNullSafe(r.session_id)).collect())
    for r in views.payloads(spark, tables).collect():
        body = json.loads(r.payload)
        body = body[0] if isinstance(body, list) else body["quotes"][0] if "quotes" in body else body
        for service in body["workSummary"][0]["services"]:
            for i in service["workItems"]:
                price = i["pricingInput"][0]
                found.append((r.session_id, body["quoteNumber"], service["serviceId"].get("name"), i["subService"].get("name"), i.get("workTitle"),
                              i.get("description"), float(price["quantity"]), i["pricingMethod"]["name"], round(float(price["grandTotal"]) * 100)))
    assert len(joined) == 11 and sorted(found, key=repr) == joined


def test_both_lanes_take_their_lines_from_one_table(spark, tables):
    """The five tables are joined once, and a line is dealt without the texts that follow from its part and quote."""
    dealt = views.quote_lists(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    moved = dealt[dealt.index("RepartitionByExpression"):].split("\n")[1]
    assert "&nbsp;size" not in moved and "session_" not in moved and ".pdf" not in moved
    both = queries.q_lane_union(spark, tables)
    assert "lineitem.parquet" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 8


def test_a_stored_step_leaves_no_shuffle_files(spark, tables, tmp_path):
    before = shuffle_files(spark)
    made = stored(views.quote_sums(spark, tables))
    assert shuffle_files(spark) <= before
    assert made.count() == views.items(spark, tables).select(*views.QUOTE, "service_category", "sub_service").distinct().count()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_pushes_are_packed_and_what_is_staged_is_removed(spark, tables, tmp_path):
    queries._pushed(views.payloads(spark, tables), str(tmp_path / "in"))
    assert glob.glob(str(tmp_path / "in" / "*.json.gz")) and not glob.glob(str(tmp_path / "in" / "*.json"))
    store = QuoteStore(spark, str(tmp_path / "store"), buckets=2)
    pushes = spark.createDataFrame([("s", json.dumps(quote("Q1"))), ("s", json.dumps(quote("Q2")))], PAYLOAD)
    sync.land_batch(store, pushes, 0, "a")
    assert store.quotes().count() == 2 and not glob.glob(str(tmp_path / "store" / "_staging" / "*"))


def test_parts_of_a_context_are_stored(spark, frame):
    lines = stored(frame([("s", "A", "C", "x", 10, 10, "d"), ("s", "A", "C", "x", 20, 20, "e"), ("s", "B", "C", "y", 5, 5, None)]).selectExpr(
        "session_id", "sub_service", "concat(vendor_name, ' (', source_filename, ')') as vendor", "description",
        "1L as n_lines", "rate_cents as rate_sum", "1L as n_rates"))
    raw = lines.selectExpr("session_id", "vendor", "rate_sum as grand_total_cents").distinct()
    context = comparison.chat_context(lines, raw)
    assert "Exchange" not in context._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.section for r in context.collect()) == ["item_rates"] * 2 + ["item_specs"] * 3 + ["vendor_totals"] * 3

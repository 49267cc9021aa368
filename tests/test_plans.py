"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from bidmatrix.operators import cells as c
from bidmatrix.operators import conformance, usage
from bidmatrix.sources import marketplace, taxonomy
from workload import views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_services_limit_before_the_shuffle(spark):
    text = plan(usage.top_services(usage.service_lines(views.items(spark, SF))))
    first, second = text.index("WindowGroupLimit"), text.rindex("WindowGroupLimit")
    assert first < text.index("Exchange") < second and "Partial" in text[second:second + 200]


def test_overall_top_uses_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(usage.top_overall(views.items(spark, SF)))


def test_official_word_bank_is_broadcast(spark):
    labels = views.items(spark, SF)
    text = plan(conformance.conforming(labels, taxonomy.official(spark)))
    assert "BroadcastHashJoin [service_category" in text and "LeftSemi" in text


def test_intake_moves_nothing(spark):
    data = spark.createDataFrame([("s", "{}")], "session_id string, payload string")
    landed = marketplace.sync(data)
    for df in landed:
        assert "Exchange" not in plan(df)
    # each quote is read into its columns once: the quality filter does not repeat it, and no text is parsed again
    text = plan(landed.quote_items)
    assert text.count("StructField(quoteNumber") == 1 and "from_json(" not in text


def test_cells_read_few_columns_and_aggregate_before_the_shuffle(spark):
    text = plan(c.cells(views.items(spark, SF)))
    assert "partial_sum(amount_cents" in text
    schema = text[text.index("ReadSchema: struct<l_orderkey"):].splitlines()[0]
    assert "l_extendedprice" in schema and "l_discount" not in schema and "l_shipdate" not in schema


def test_session_filter_reaches_both_tables(spark, tmp_path):
    items, quotes = str(tmp_path / "i"), str(tmp_path / "q")
    views.quote_items(spark, SF).write.parquet(items)
    views.quotes(spark, SF).write.parquet(quotes)
    joined = c.join_quotes(spark.read.parquet(items), spark.read.parquet(quotes))
    text = plan(c.cells(joined).where(F.col("session_id") == "session_0_0"))
    assert text.count("EqualTo(session_id,session_0_0)") == 2


@pytest.mark.parametrize("name", ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"])
def test_no_query_uses(spark, name):
    from workload.queries import REGISTRY

    eager = {"q_stream_ingest", "q_stream_cells", "q_stored_bundle"}
    if not hasattr(test_no_query_uses, "plans"):
        test_no_query_uses.plans = {q: plan(fn(spark, SF)) for q, fn in REGISTRY.items() if q not in eager}
    assert [q for q, text in test_no_query_uses.plans.items() if name in text] == []

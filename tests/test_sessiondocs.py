"""Session documents: whole, in order, and in several pieces when they are large."""

import json
import os

import pytest
from pyspark.sql import functions as F

from bidmatrix.plans import comparison
from bidmatrix.sources import sessiondocs
from conftest import rows

BUNDLE = "session_id string, section string, sort_number bigint, sort_text string, entry string"


def document(path, session):
    return json.loads(b"".join(sessiondocs.read_document(str(path), session)))


def wanted(entries, session):
    """The document put together from collected entries."""
    own = sorted((e for e in entries if e.session_id == session), key=lambda e: (e.sort_number is not None, e.sort_number or 0, e.sort_text))
    of = lambda section, read: [read(e.entry) for e in own if e.section == section]
    return {
        "report": (of("report", str) or [None])[0], "chartData": of("chartData", json.loads), "tableData": of("tableData", json.loads),
        "vendors": of("vendors", str), "session_id": session,
    }


ODD = 'a/b "c" +%ü\n*'


def test_documents_hold_the_bundle_in_order(spark, frame, tmp_path):
    items = frame([
        ("s", "A", "C", "x", 100), ("s", "B", "C", "x", 300), ("s", "A", "C", 'y "quoted"', 50), ("t", "A", "C", "x", 7),
        (ODD, "A\n", "C", "x", 1), (ODD, "B", "D", "x\\", 0), ("z" * 300, "A", "C", "x", 5),
    ])
    quotes = items.groupBy("session_id", "quote_id", "vendor_name", "source_filename").agg(F.sum("amount_cents").alias("grand_total_cents"))
    quotes = quotes.withColumn("quote_date", F.lit(None).cast("string"))
    bundle = comparison.compare(items, quotes)
    entries = bundle.collect()
    sessiondocs.write_documents(bundle, str(tmp_path))
    for session in {e.session_id for e in entries}:
        assert document(tmp_path, session) == wanted(entries, session)
    assert b"".join(sessiondocs.read_document(str(tmp_path), "none")) == b""
    short = bundle.where("length(session_id) < 100")
    back = sessiondocs.entries(sessiondocs.read_lines(spark, str(tmp_path))).where("length(session_id) < 60 or session_id not rlike '^[0-9a-f]{64}$'")
    assert rows(back, "session_id", "section", "entry") == rows(short, "session_id", "section", "entry")


def test_sections_without_entries_and_repeated_ones(spark, tmp_path):
    data = [("s", "chartData", 5, "v", '{"vendor":"v","total":0.05}')] * 3 + [("t", "report", None, "", "text"), (None, "vendors", None, "v", "v")]
    sessiondocs.write_documents(spark.createDataFrame(data, BUNDLE), str(tmp_path))
    assert document(tmp_path, "s") == {"report": None, "chartData": [{"vendor": "v", "total": 0.05}] * 3, "tableData": [], "vendors": [], "session_id": "s"}
    assert document(tmp_path, "t") == {"report": "text", "chartData": [], "tableData": [], "vendors": [], "session_id": "t"}
    sessiondocs.write_documents(spark.createDataFrame([], BUNDLE), str(tmp_path))  # replaces all
    assert sessiondocs.pieces_of(str(tmp_path)) == [] and sessiondocs.read_lines(spark, str(tmp_path)).count() == 0
    assert os.listdir(tmp_path) == ["_documents.json"]
    with pytest.raises(Exception, match="overwrite"):
        lines = spark.createDataFrame([], "session_id string, kind int, text string")
        lines.write.format("session_documents").mode("append").save(str(tmp_path))


def test_a_large_session_is_written_by_several_tasks(spark, tmp_path):
    n = 1_000_000
    place = F.lpad(F.col("id").cast("string"), 7, "0")
    entry = F.concat(F.lit('{"category":"C","sub_service":"'), place, F.lit('","market_average":1.00,"vendor":"v","amount":'), "id", F.lit(".00}"))
    hot = spark.range(n).select(F.lit("hot").alias("session_id"), F.lit("tableData").alias("section"), F.lit(None).cast("bigint").alias("sort_number"), place.alias("sort_text"), entry.alias("entry"))
    small = spark.createDataFrame([(s, "vendors", None, "v", "v") for s in ("a", "z")], BUNDLE)
    sessiondocs.write_documents(hot.unionByName(small), str(tmp_path))
    assert len(sessiondocs.pieces_of(str(tmp_path))) > 1
    held = document(tmp_path, "hot")["tableData"]
    assert len(held) == n and all(e["amount"] == k for k, e in enumerate(held))
    assert document(tmp_path, "a")["vendors"] == document(tmp_path, "z")["vendors"] == ["v"]


def test_what_a_failed_attempt_left_is_not_read(spark, tmp_path):
    bundle = spark.createDataFrame([("s", "vendors", None, "v", "v")], BUNDLE)
    sessiondocs.write_documents(bundle, str(tmp_path))
    left = tmp_path / "000000-left"
    left.mkdir()
    (left / "s.json").write_text("half")
    assert document(tmp_path, "s")["vendors"] == ["v"]
    sessiondocs.write_documents(bundle, str(tmp_path))
    assert not left.exists()


def test_many_documents_are_read_by_few_tasks_and_the_bundle_once(spark, tmp_path):
    """A task reads the documents of a piece however many there are; what writes them does not repeat the work behind the bundle."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n = 600
    session = F.concat(F.lit("s %+é/"), F.col("id").cast("string"))
    made = spark.range(n).select(session.alias("session_id"), F.lit("vendors").alias("section"), F.lit(None).cast("bigint").alias("sort_number"), F.lit("v").alias("sort_text"), F.lit('v "é"').alias("entry"))
    sessiondocs.write_documents(made.mapInArrow(counted, BUNDLE), str(tmp_path))
    assert seen.value == n
    lines = sessiondocs.read_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == len(sessiondocs.pieces_of(str(tmp_path)))
    assert rows(sessiondocs.entries(lines), "session_id", "section", "entry") == rows(made, "session_id", "section", "entry")

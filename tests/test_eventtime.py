"""Runs of events, and streams whose records come late, out of order and repeatedly."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from bidmatrix.operators.sittings import micros, sittings
from bidmatrix.streaming import eventtime
from conftest import rows

START = datetime(2024, 1, 1)
RECORD = "id long, owner string, ts timestamp, cents long"


def plain_runs(records, gap):
    """(owner, first, last, n, cents) of each run."""
    out, by = [], {}
    for owner, at, cents in records:
        if at is not None:
            by.setdefault(owner, []).append((at, cents))
    for owner, own in by.items():
        run = []
        for at, cents in sorted(own) + [(None, 0)]:
            if run and (at is None or at - run[-1][0] > gap):
                out.append((owner, run[0][0], run[-1][0], len(run), sum(c for _, c in run)))
                run = []
            run.append((at, cents))
    return sorted(out, key=repr)


def test_runs_against_a_plain_loop(spark):
    rng = random.Random(1)
    records = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-300, 300)]), rng.randrange(9)) for _ in range(400)]
    records += [("hot", t, 1) for t in range(0, 5000, 3)] + [("hot", 9000, 1), ("hot", 9010, 1), ("hot", 9021, 1)]
    frame = spark.createDataFrame(records, "owner string, at long, cents long")
    for gap, bin_size in ((10, 7), (10, 100), (0, 50), (3, 1_000_000), (10, 10)):
        got = sittings(frame, "owner", "at", gap, bin_size, cents=F.col("cents"))
        assert got.columns == ["owner", "sitting_no", "started", "ended", "n_events", "cents"]
        assert rows(got, "owner", "started", "ended", "n_events", "cents") == plain_runs(records, gap)
        numbers = got.groupBy("owner").agg(F.count("*").alias("n"), F.max("sitting_no").alias("last"), F.min("sitting_no").alias("first"))
        assert all(r.n == r.last and r.first == 1 for r in numbers.collect())
    assert sittings(frame.where("false"), "owner", "at", 1, 1).count() == 0


def test_microseconds_do_not_depend_on_the_time_zone(spark):
    frame = spark.sql("select timestamp_ntz'1970-01-02 00:00:00.000005' as `the time`")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert frame.select(micros("the time")).first()[0] == 86_400_000_005
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def at(hours):
    return None if hours is None else START + timedelta(hours=hours)


def arrive(spark, folder, records):
    spark.createDataFrame([(i, o, at(h), c) for i, o, h, c in records], RECORD).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def test_totals_of_late_and_repeated_records(spark, tmp_path):
    def run():
        stream = spark.readStream.schema(RECORD).parquet(str(tmp_path / "in"))
        query = eventtime.start_totals(
            eventtime.once(stream, "ts", "10 hours", "id"), ["owner"], {"cents": F.col("cents")}, str(tmp_path / "totals"), str(tmp_path / "cp"))
        query.awaitTermination()
        return query

    arrive(spark, tmp_path, [(1, "a", 0, 5), (2, "a", 20, 7), (1, "a", 0, 5), (None, "b", 1, 2), (None, "b", 1, 2), (None, "b", 2, 2), (3, "a", None, 9)])
    first = run()
    assert eventtime.left_out(first) == 0
    arrive(spark, tmp_path, [(2, "a", 20, 7), (4, "a", 12, 1), (5, None, 15, 3)])  # sent again, and late in any order
    second = run()
    assert eventtime.left_out(second) == 0 and eventtime.held(second) > 0
    want = [("a", 3, 13), ("b", 2, 4), (None, 1, 3)]
    got = lambda: sorted((tuple(r) for r in eventtime.totals(spark, str(tmp_path / "totals"), ["owner"], ["cents"]).collect()), key=lambda r: (r[0] is None, r[0]))
    assert got() == want
    arrive(spark, tmp_path, [(6, "a", 500, 0)])
    assert eventtime.held(run()) == 1  # only the last record is remembered
    arrive(spark, tmp_path, [(1, "a", 0, 5), (7, "a", 30, 8)])  # one sent again, one new, both later than the delay
    last = run()
    assert eventtime.left_out(last) == 2
    assert got() == [("a", 4, 13), *want[1:]]


def test_runs_of_a_stream_close_once_and_leave_no_state(spark, tmp_path):
    rng = random.Random(2)
    records = [(i, rng.choice("ab"), rng.randrange(0, 300), rng.randrange(9)) for i in range(150)]
    end = [(10**6, "end", 10_000, 0)]

    def run():
        stream = spark.readStream.schema(RECORD).parquet(str(tmp_path / "in"))
        query = eventtime.start_sittings(
            stream, "owner", "ts", "48 hours", "3 hours", {"cents": F.col("cents")}, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
        return query

    in_order = sorted(records, key=lambda r: r[2] + rng.randrange(48))
    for part in (in_order[:70], in_order[70:110], in_order[110:], end):
        arrive(spark, tmp_path, part)
        last = run()
    got = spark.read.parquet(str(tmp_path / "out"))
    hours = lambda c: (F.unix_timestamp(c) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600
    found = got.select("owner", hours("started").cast("int").alias("started"), hours("ended").cast("int").alias("ended"), "n_records", "cents")
    assert rows(found, *found.columns) == plain_runs([r[1:] for r in records], 3)
    assert eventtime.held(last) == 1  # the run of the last record is still open

"""Joins along time against plain loops, with hot keys, ties, nulls and empty sides."""

import random
import re

import pytest

from bidmatrix.operators.asof import as_of, overlaps

ASK, GIVEN = "ask_id int, k string, at bigint", "k string, since bigint, quote_id string, cents bigint"


def plain_as_of(asking, given):
    out = []
    for i, k, at in asking:
        fits = [(s, q, c) for g, s, q, c in given if g is not None and g == k and s is not None and at is not None and s <= at]
        out.append((i, k, at, *(max(fits) if fits else (None, None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bin_size", (1, 7, 1_000))
def test_as_of(spark, bin_size):
    rnd = random.Random(bin_size)
    key = lambda: rnd.choice(["hot"] * 4 + ["a", "b", None])
    asking = [(i, key(), rnd.choice([None, rnd.randrange(-40, 200)])) for i in range(400)] + [(400 + i, "hot", 50) for i in range(60)]
    given = [(key(), rnd.choice([None, rnd.randrange(-20, 180)]), f"q{rnd.randrange(40):02d}", rnd.randrange(9)) for _ in range(150)] * 2
    got = as_of(spark.createDataFrame(asking, ASK), spark.createDataFrame(given, GIVEN), "k", "at", "since", bin_size, ["quote_id", "cents"])
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_as_of(asking, given)


def test_as_of_with_empty_sides(spark):
    some = spark.createDataFrame([(1, "a", 5)], ASK)
    none = spark.createDataFrame([], GIVEN)
    assert [tuple(r) for r in as_of(some, none, "k", "at", "since", 10, ["quote_id"]).collect()] == [(1, "a", 5, None, None, None)]
    assert as_of(some.limit(0), none, "k", "at", "since", 10, ["quote_id"]).count() == 0


def test_hot_key_is_spread_over_bins(spark):
    """A task's window holds one bin of a key: no window is by the key alone but the one over bins."""
    asking = spark.range(50_000).selectExpr("cast(id as int) ask_id", "'hot' k", "id % 20000 at")
    given = spark.range(20_000).selectExpr("'hot' k", "id since", "concat('q', id) quote_id", "id cents")
    got = as_of(asking, given, "k", "at", "since", 500, ["quote_id"])
    assert got.where("cents = at").count() == 50_000


def plain_overlaps(left, right):
    real = lambda k, a, b: k is not None and a is not None and b is not None and a < b
    return sorted(
        (k, i, a, b, j, c, d, max(a, c), min(b, d))
        for k, i, a, b in left if real(k, a, b) for g, j, c, d in right if real(g, c, d) and g == k and max(a, c) < min(b, d)
    )


@pytest.mark.parametrize("levels", (0, 2, 12))
def test_overlaps(spark, levels):
    rnd = random.Random(levels)

    def spans(n):
        out = []
        for i in range(n):
            begin, length = rnd.randrange(-300, 300), rnd.choice([0, -3, 1, 4, 5, 16, 17, rnd.randrange(1, 600)])
            out.append((rnd.choice(["hot", "hot", "a", None]), i, rnd.choice([begin, begin, begin, None]), begin + length))
        return out

    left, right = spans(150), spans(120)
    a = spark.createDataFrame(left, "k string, i int, a bigint, b bigint")
    b = spark.createDataFrame(right, "k string, j int, c bigint, d bigint")
    got = overlaps(a, b, "k", ("a", "b"), ("c", "d"), levels)
    assert sorted(tuple(r) for r in got.collect()) == plain_overlaps(left, right)
    assert overlaps(a, b.limit(0), "k", ("a", "b"), ("c", "d"), levels).count() == 0


def test_repeated_spans_do_not_pass_through_the_driver(spark, tmp_path):
    """Small files hold spans that make many rows: neither side is broadcast."""
    spark.range(2_000).selectExpr("'hot' k", "id a", "id + 1 b").write.parquet(str(tmp_path / "l"))
    spark.range(50).selectExpr("'hot' k", "id * 10 c", "id * 10 + 300 d").write.parquet(str(tmp_path / "r"))
    met = overlaps(spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "r")), "k", ("a", "b"), ("c", "d"))
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == sum(1 for a in range(2_000) for c in range(0, 500, 10) if c <= a < c + 300)


def test_rows_that_ask_are_moved_once(spark):
    """The moments asked for do not go through shuffles of their own: the only one by the rows' time is by its bin."""
    asking = spark.range(1_000).selectExpr("cast(id as int) ask_id", "'hot' k", "id at")
    given = spark.range(50).selectExpr("'hot' k", "id * 20 since", "concat('q', id) quote_id", "id cents")
    got = as_of(asking, given, "k", "at", "since", 100, ["quote_id"])
    assert got.where("cents = at div 20").count() == 1_000
    shuffles = [x.split(", ENSURE")[0] for x in got._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:]]
    assert not [x for x in shuffles if re.search(r"\b(at|moment)#", x) and "FLOOR" not in x]

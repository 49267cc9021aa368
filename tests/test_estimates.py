"""Quantile sketches and samples: exact where small, inside their bounds where large, alike in parts."""

import random
from statistics import mean

from bidmatrix.operators import quantiles, sampling
from pyspark.sql import functions as F

SHARES = [0.0, 0.25, 0.5, 0.9, 1.0]


def test_small_groups_are_exact_and_merge(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("abc"), f"s{i % 3}", rnd.choice([None, *range(50)])) for i in range(300)] + [("z", "s0", None)]
    df = spark.createDataFrame(rows, "batch string, s string, v bigint")
    parts = quantiles.sketches(df, ["batch", "s"], "v")
    got = {r["s"]: r for r in quantiles.quantiles(quantiles.merged(parts, ["s"]), ["s"], SHARES).collect()}
    for s in ("s0", "s1", "s2"):
        values = sorted(v for _, g, v in rows if g == s and v is not None)
        want = [next(x for x in values if sum(y <= x for y in values) >= share * len(values)) for share in SHARES]
        assert got[s]["n_values"] == len(values) and got[s]["answers"] == want
    assert quantiles.merged(parts.limit(0), ["s"]).count() == 0


def test_large_group_is_inside_its_bound(spark):
    n, k = 200_000, 200
    df = spark.range(n).selectExpr("'hot' s", "id % 7 batch", "(id * 7919) % 200003 v")
    merged = quantiles.merged(quantiles.sketches(df, ["s", "batch"], "v", k), ["s"], k)
    answers = quantiles.quantiles(merged, ["s"], SHARES)
    r = quantiles.ranked(df, ["s"], "v", answers, len(SHARES)).first()
    off = 3 * quantiles.rank_error(k) * n
    assert all(b - off <= share * n <= u + off for share, b, u in zip(SHARES, r["below"], r["up_to"]))
    assert merged.select(F.length("sketch")).first()[0] < 20_000


def samples(df, size, seed=7):
    low = sampling.smallest(sampling.units(df, ["s"], ["u"], "v", seed), ["s"], ["u"], size)
    return sampling.sample(low, ["s"], size)


def test_samples_alike_in_parts_and_on_rerun(spark):
    df = spark.range(3_000).selectExpr("if(id % 3 = 0, null, 'a') s", "if(id = 5, null, id div 2) u", "if(id % 10 = 0, null, id) v")
    whole = sorted(map(tuple, samples(df, 40).collect()), key=repr)
    assert whole == sorted(map(tuple, samples(df.repartition(5), 40).collect()), key=repr) and len(whole) == 80
    numbered = sampling.units(df, ["s"], ["u"], "v", 7)
    low = lambda rows: sampling.smallest(rows, ["s"], ["u"], 40)
    parts = low(numbered.where("u % 2 = 0")).unionByName(low(numbered.where("u % 2 = 1 or u is null")))
    assert sorted(map(tuple, sampling.sample(low(parts), ["s"], 40).select(*samples(df, 40).columns).collect()), key=repr) == whole


def test_estimates(spark):
    df = spark.range(2_000).selectExpr("'a' s", "id u", "100 + id % 50 v").unionAll(spark.range(5).selectExpr("'b' s", "id u", "id v"))
    total = df.where("s = 'a'").agg(F.sum("v")).first()[0]
    by_seed = []
    for seed in range(8):
        rows = {r["s"]: r for r in sampling.estimates(samples(df, 300, seed), ["s"]).collect()}
        assert rows["b"]["estimated_rows"] == 5 and rows["b"]["estimated_sum"] == 10 and rows["a"]["n_sampled"] == 300
        by_seed.append(rows["a"]["estimated_sum"] / total)
    assert max(abs(e - 1) for e in by_seed) < 0.25 and abs(mean(by_seed) - 1) < 0.07
    assert sampling.estimates(samples(df.limit(0), 3), ["s"]).count() == 0


def test_answers_repeated_over_salts_are_not_broadcast(spark):
    df = spark.range(1_000).selectExpr("id % 3 g", "id v")
    answers = quantiles.quantiles(quantiles.sketches(df, ["g"], "v"), ["g"], SHARES)
    found = quantiles.ranked(df, ["g"], "v", answers, len(SHARES))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan

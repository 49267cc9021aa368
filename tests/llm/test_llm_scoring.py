"""Toxicity, resampling and hard negatives against plain versions of themselves."""

import itertools
import math
import re
import time
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidmatrix.llm import langid, licenses, negatives, queries, resampling, toxicity
from llm_helpers import LONG, given, no_docs, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11 toxicity

def laid_out(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    return data, np.cumsum([0, *map(len, raw)])


def some_field(seed=3):
    rng = np.random.default_rng(seed)
    return toxicity.Field(rng.normal(size=1 << toxicity.BITS).astype(np.float32), rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2))


def all_taggings(model, evidence):
    """Weight of every way to tag one chain."""
    out = {}
    for tags in itertools.product((0, 1), repeat=len(evidence)):
        w = model.start[tags[0]] + model.end[tags[-1]] + sum(e for e, t in zip(evidence, tags) if t)
        out[tags] = math.exp(w + sum(model.follow[a, b] for a, b in zip(tags, tags[1:])))
    return out


def test_words_and_chains():
    data, cuts = laid_out(["One two. Three!", "", "ÉTÉ été x\ny", "w " * 130])
    words = toxicity.words_of(data, cuts)
    lower = toxicity.lowered(data).tobytes()
    assert [lower[a:b].decode() for a, b in zip(words.starts, words.ends)] == ["one", "two", "three", "été", "été", "x", "y"] + ["w"] * 130
    assert words.text.tolist() == [0] * 3 + [2] * 4 + [3] * 130
    assert words.chain.tolist() == [0, 0, 1, 2, 2, 2, 3] + [4] * 64 + [5] * 64 + [6] * 2
    same = words.evidence[0]
    assert same[3] == same[4] and len({same[0], same[1], same[2], same[3]}) == 4
    assert (words.evidence[:, words.ends - words.starts < 3][7:10] == -1).all()  # too short for an ending
    assert words.evidence[toxicity.OWN, 0] == -1 and words.evidence[toxicity.OWN, 4] != -1


def test_span_hashes_are_those_of_the_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    starts = rng.integers(0, 2900, 2000)
    ends = starts + rng.integers(1, 6, 2000)
    found = toxicity.SpanHash(data).of(starts, ends, 2)
    by_bytes = {}
    for h, a, b in zip(found.tolist(), starts, ends):
        by_bytes.setdefault(data[a:b].tobytes(), set()).add(h)
    assert all(len(v) == 1 for v in by_bytes.values())
    assert len(set().union(*by_bytes.values())) > 0.98 * len(by_bytes)


@pytest.mark.parametrize("seed", range(4))
def test_marginals_are_those_of_all_taggings(seed):
    model = some_field(seed)
    rng = np.random.default_rng(seed)
    sizes = [1, 5, 3, 3, 7, 1]
    chain, place = np.repeat(np.arange(6), sizes), np.concatenate([np.arange(n) for n in sizes])
    evidence = rng.normal(size=len(chain)) * 2
    toxic, pairs, ends, total = model.marginals(evidence, toxicity.Chains.of(chain, place))
    wanted, wanted_pairs, wanted_ends, wanted_total = [], np.zeros((2, 2)), np.zeros((2, 2)), 0.0
    for c, n in enumerate(sizes):
        ways = all_taggings(model, evidence[chain == c])
        z = sum(ways.values())
        wanted_total += math.log(z)
        wanted += [sum(w for t, w in ways.items() if t[i]) / z for i in range(n)]
        for t, w in ways.items():
            for a, b in zip(t, t[1:]):
                wanted_pairs[a, b] += w / z
            wanted_ends[0, t[0]] += w / z
            wanted_ends[1, t[-1]] += w / z
    assert np.allclose(toxic, wanted) and np.allclose(pairs, wanted_pairs) and np.allclose(ends, wanted_ends) and np.isclose(total, wanted_total)
    assert np.allclose(model.marginals_only(evidence, toxicity.Chains.of(chain, place)), wanted)


def test_gradients_are_those_of_the_likelihood():
    model = some_field(9)
    words = toxicity.words_of(*laid_out(["bad idiot here. fine words", "idiot"]))
    tags = np.array([0, 1, 0, 0, 0, 1])

    def loss():
        total, at = 0.0, 0
        evidence = model.evidence(words)
        for c in range(words.chain[-1] + 1):
            own = words.chain == c
            ways = all_taggings(model, evidence[own])
            total += math.log(sum(ways.values())) - math.log(ways[tuple(tags[own])])
        return total

    found = toxicity.gradients(model, words.evidence, tags, words.chain, words.place)
    spots = [("follow", (0, 1)), ("follow", (1, 0)), ("start", (1,)), ("end", (0,))] + [("weights", (int(k),)) for k in words.evidence[:, 1] if k >= 0]
    for name, at in spots:
        values, step = getattr(model, name), 1e-2 if name == "weights" else 1e-5
        before = values[at]
        values[at] = before + step
        up = loss()
        values[at] = before - step
        down = loss()
        values[at] = before
        assert np.isclose((up - down) / (2 * step), found[name][at], atol=2e-3), (name, at)


def test_spans_count_code_points():
    texts = ["été 😀 idiot clown ok. idiot", "", "ok idiot"]
    data, cuts = laid_out(texts)
    words = toxicity.words_of(data, cuts)
    low = toxicity.lowered(data).tobytes()
    marginals = np.array([0.75 if low[a:b] in (b"idiot", b"clown") else 0.25 for a, b in zip(words.starts, words.ends)])
    found = toxicity.spans_of(words, marginals, data, cuts).to_pylist()
    assert [[t[s["start"] : s["end"]] for s in f] for t, f in zip(texts, found)] == [["idiot clown", "idiot"], [], ["idiot"]]


def test_near_copies_teach_once():
    rng = np.random.default_rng(0)
    draw = lambda: [f"w{x}" for x in rng.integers(0, 500, 60)]
    one, two = draw(), draw()
    near = one[:30] + ["changed"] + one[31:]
    words = toxicity.words_of(*laid_out([" ".join(t) for t in (one, two, near, one)]))
    assert toxicity.different(words, 4).tolist() == [True, True, False, False]


def test_held_out_toxic_texts_are_found(spark):
    docs, labels = given(spark, "documents", "sf0.1"), given(spark, "labels", "sf0.1")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    wanted = {r["doc_id"]: r["toxic"] for r in labels.where(toxicity.held_out(F.col("doc_id"))).collect()}
    out = {r["doc_id"]: r for r in toxicity.judge(docs.select("doc_id", "text"), model).collect()}
    assert len(out) == docs.count()
    hit = sum(out[k]["predicted"] for k, t in wanted.items() if t == 1)
    wrong = sum(out[k]["predicted"] for k, t in wanted.items() if t == 0)
    assert hit >= 0.9 * sum(wanted.values()) and wrong <= 0.01 * len(wanted)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())


def test_toxicity_of_odd_tables(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame(
        [(1, 0), (1, 1), (3, 0), (5, 0), (6, 0), (7, None), (None, 1), (8, 0), (99, 1)], "doc_id long, toxic int"
    )
    model = toxicity.fit(docs, labels)
    again = toxicity.fit(docs.repartition(3), labels)
    assert (model.field.weights == again.field.weights).all() and (model.curve == again.curve).all()  # reruns agree
    out = toxicity.judge(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted", "spans"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert by_text[None] == by_text[""] == by_text["  \t\n "]
    assert toxicity.judge(no_docs(spark), model).count() == 0
    assert toxicity.fit(docs, labels.where("false")) is None
    assert {(r["score"], r["predicted"], len(r["spans"])) for r in toxicity.judge(docs, None).collect()} == {(0.0, 0, 0)}
    one_kind = toxicity.fit(docs, labels.where("toxic = 0"))
    assert all(r["predicted"] == 0 for r in toxicity.judge(docs, one_kind).collect())


# 12 resampling

@settings(max_examples=40, deadline=None)
@examples(st.binary(max_size=400), st.data())
def test_checksums_are_crc32(data, draw):
    spans = draw.draw(st.lists(st.tuples(st.integers(0, len(data)), st.integers(0, len(data))).map(sorted), max_size=30))
    starts, ends = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    found = resampling.crc32_spans(np.frombuffer(data, np.uint8), starts, ends)
    assert found.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


@pytest.mark.parametrize("length", [0, 1, 3, 4, 63, 64, 65, 127, 128, 129, 1000, 5000])
def test_checksums_of_long_spans(length):
    data = np.random.default_rng(length).integers(0, 256, 9000).astype(np.uint8)
    starts = np.array([0, 7, 3999])
    found = resampling.crc32_spans(data, starts, starts + length)
    assert found.tolist() == [zlib.crc32(data[a : a + length].tobytes()) for a in starts]


def plain_resample(docs, target, s):
    def features(text):
        words = WORD.findall((text or "").translate(ASCII_LOWER))
        runs = [" ".join(words[i : i + n]) for n in range(s.least, s.most + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % s.buckets for r in runs]

    here, there = [0] * s.buckets, [0] * s.buckets
    for rows, counts in ((docs, here), (target, there)):
        for row in rows:
            for b in features(row[-1])[1]:
                counts[b] += 1
    n, m, k = sum(here), sum(there), s.buckets
    gain = [math.floor(1000 * math.log((t + 1) * (n + k) / ((c + 1) * (m + k)))) for c, t in zip(here, there)]
    out = []
    for doc_id, text in docs:
        n_words, found = features(text)
        h = int(sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, n_words >= s.words])
    eligible = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(eligible[: len(eligible) * s.percent // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def resampled(docs, target, s):
    found = resampling.resample(docs, target, s)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("setting", [
    resampling.Setting(), resampling.Setting(most=2, buckets=500, percent=50, words=1), resampling.Setting(least=2, most=3, buckets=97, percent=100, words=5),
])
def test_resampling_of_odd_and_given_tables(spark, setting):
    docs = odd_docs(spark).select("doc_id", "text").unionByName(given(spark, "documents").select("doc_id", "text")).repartition(5)
    target = given(spark, "benchmark").select("text").unionByName(spark.createDataFrame([(None,), ("",)], "text string"))
    plain = plain_resample([tuple(r) for r in docs.collect()], [tuple(r) for r in target.collect()], setting)
    assert resampled(docs, target, setting) == plain


def test_resampling_of_ties_extra_columns_and_nothing(spark):
    setting = resampling.Setting(words=1, percent=50)
    docs = odd_docs(spark).withColumn("place", F.lit(1)).withColumn("row", F.lit(2))
    repeated = docs.unionByName(docs).unionByName(docs)
    target = spark.createDataFrame([("three words",)], "text string")
    plain = plain_resample([tuple(r) for r in repeated.select("doc_id", "text").collect()], [("three words",)], setting)
    assert resampled(repeated, target, setting) == plain
    assert resampled(no_docs(spark), target, setting) == []
    assert resampled(docs, target.where("false"), setting) == plain_resample([tuple(r) for r in docs.select("doc_id", "text").collect()], [], setting)


# 13 hard negatives

def plain_negatives(rows, m=negatives.Mining()):
    usable = []
    for at, (vec_id, label, vector) in enumerate(rows):
        if vec_id is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((vec_id, at, label, [math.floor(m.scale * x) for x in vector]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for vec_id, at, label, q in usable:
        if vec_id % 100:
            continue
        others = [(-dot(q, v), i, k, lab) for i, k, lab, v in usable if len(v) == len(q) and k != at]
        others.sort()
        for score, positive, _, _ in [o for o in others if o[3] == label][: m.positives]:
            inside = [o for o in others if o[3] != label and m.low * -score <= 100 * -o[0] <= m.high * -score]
            out += [(vec_id, positive, r + 1, o[1], -score, -o[0]) for r, o in enumerate(inside[: m.negatives])]
    return sorted(out)


def mined(spark, rows, m=negatives.Mining(), kind="double"):
    frame = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").withColumn("chunk", F.lit(1)).withColumn("row", F.lit("x"))
    out = negatives.mine(frame.repartition(3), F.col("vec_id") % 100 == 0, m)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    near = (np.ones(6) / 6**0.5 + rng.normal(size=(60, 6)) * 0.1).tolist()
    rows = [(i * 20, i % 3, v) for i, v in enumerate(near)]
    rows += [(i * 50 + 7, 1, near[0]) for i in range(20)]  # ties
    rows += [(100, 1, near[3]), (100, 1, near[3]), (200, 2, [0.0] * 6), (300, 0, [0.0] * 6), (400, 1, [-x for x in near[1]])]
    rows += [(500, 1, [1.0, 2.0]), (501, 1, [1.0, 2.5]), (502, 2, [1.0, 2.25]), (600, 1, []), (700, 1, None), (800, None, near[0]), (None, 1, near[0])]
    rows += [(900, 1, [float("nan")] * 6), (1000, 1, [float("inf"), *near[0][1:]]), (1100, 1, [None, *near[0][1:]]), (1203, 1, [-0.001] * 6)]
    for setting in (negatives.Mining(), negatives.Mining(positives=2, negatives=9, low=50, high=120, references=3, rows=4, chunks=80, part=3)):
        assert mined(spark, rows, setting) == plain_negatives(rows, setting)
    assert mined(spark, []) == []


@pytest.mark.parametrize("size", [1e4, 3e6, 3e9])
def test_large_components_stay_exact(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i * 10, i % 2, (rng.uniform(0.5, 1, 5) * size).tolist()) for i in range(60)]
    top = 2**63 - 1
    plain = plain_negatives(rows)
    if max(r[4] for r in plain) <= top:
        assert mined(spark, rows) == plain
    else:  # scores beyond 64 bits count as the largest
        assert all(r[4] <= top and r[5] <= top for r in mined(spark, rows))


def test_given_vectors_in_many_small_chunks(spark):
    frame = given(spark, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>"))
    rows = [(r[0], (r[1] + 1) % 10 if r[0] % 7 == 0 else r[1], r[2]) for r in frame.collect()]
    small = negatives.Mining(rows=8, part=2)
    assert mined(spark, rows, small) == plain_negatives(rows) == sorted(tuple(r) for r in queries.op13_hard_negatives(spark, "/root/testdata/sf0.001").collect())


@settings(max_examples=60, deadline=None)
@examples(st.integers(0, 10**6))
def test_bounds_hold_for_every_pair(seed):
    """Scores lie inside the chunk's bounds, and vectors that fit a window inside its stretch."""
    rng = np.random.default_rng(seed)
    dim = int(rng.integers(1, 9))
    near = rng.normal(size=(1, dim)) * rng.integers(0, 3)
    vectors = np.floor((near + rng.normal(size=(40, dim)) * rng.choice([0.001, 0.3, 5])) * 256)
    references = negatives.directions(vectors, 4, 1)
    norms = np.linalg.norm(vectors, axis=1)
    angles = negatives.angles_to(vectors, norms, references).astype(np.float32).astype(np.float64)
    scores = vectors @ vectors.T
    bounds = negatives.cosine_bounds(angles[:, None], angles.min(axis=0)[None, None], angles.max(axis=0)[None, None])
    low, high = negatives.score_bounds(bounds, norms[:, None], norms.min()[None, None], norms.max()[None, None])
    assert (scores >= low).all() and (scores <= high).all()
    order = np.argsort(angles[:, 0])
    lows = rng.choice(scores.ravel(), 40).astype(np.int64)
    highs = lows + rng.integers(0, max(2, int(np.abs(scores).max())), 40)
    start, stop = negatives.stretch(angles[order, 0], angles[:, 0], norms, norms.min(), norms.max(), lows, highs)
    for a in range(40):
        fits = np.flatnonzero((scores[a][order] >= lows[a]) & (scores[a][order] <= highs[a]))
        assert ((fits >= start[a]) & (fits < stop[a])).all()


# 2 licences: long texts of many hits

@settings(max_examples=200, deadline=None)
@examples(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 6), st.integers(1, 3), st.sampled_from("abc")), max_size=25))
def test_overlaps_are_resolved_as_pair_by_pair(drawn):
    found = [(start, start + size, priority, name) for start, size, priority, name in drawn]
    kept = []
    for _, hit in sorted(enumerate(found), key=lambda x: (-x[1][2], x[1][0] - x[1][1], x[0])):
        if not any(k[0] <= hit[0] and hit[1] <= k[1] for k in kept):
            kept.append(hit)
    assert licenses.resolve(found) == kept


@pytest.mark.parametrize("text", ["mit license and text ", "cc by other words here "])
def test_long_texts_of_many_hits(text):
    words, n = len(text.split()), 5_000_000 // len(text)
    began = time.process_time()
    out = licenses.scan_text(text.encode() * n)
    assert time.process_time() - began < 10
    assert out[0] == words * n and out[7] == n
    if text.startswith("cc by"):
        assert out[1:5] == (n, 0, words * (n - 1), "cc-by")


# 1 language: what the sample may hold

def test_language_sample_is_bounded(spark):
    setting = langid.Training(rows=5, windows=2, languages=3)
    many = [(i, f"text of number {i} " * 40, f"l{i % 4}") for i in range(200)] + [(7, f"again {k} " * 60, "l3") for k in range(500)]
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string")
    windows, labels = langid.sample(docs, setting)
    assert len(set(labels)) == 3 and max(map(labels.count, set(labels))) <= setting.rows * setting.windows
    again = langid.sample(docs.repartition(7), setting)
    assert (windows == again[0]).all() and labels == again[1]


def test_a_text_is_judged_by_the_mean_of_its_windows(spark):
    docs = given(spark, "documents", "sf0.01")
    network = langid.fit(docs, langid.Training(rows=40, steps=60))
    for (text,) in docs.select("text").where("length(text) > 2000").limit(20).collect():
        data = np.frombuffer(text.encode(), np.uint8)
        total = sum((w != 32).sum() * langid.Applied(network).shares(w[None])[0].astype(float) for w in langid.windows_of(data))
        lang, score = langid.judge(data, langid.Applied(network))
        assert lang == network.labels[int(total.argmax())] and math.isclose(score, total.max() / total.sum(), rel_tol=1e-5)

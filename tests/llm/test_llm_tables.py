"""Embeddings, chats, URLs, components and the pipeline against plain versions of themselves."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from bidmatrix.llm import chat, langid, packing, queries, urls, vectors
from bidmatrix.llm.common import global_rank
from bidmatrix.llm.components import connected_components
from llm_helpers import classes, given, no_docs, odd_docs, plain_groups


# shared parts

def test_components_of_chains_stars_and_repeats(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1_000, 1_000 + i) for i in range(1, 500)]
    odd = [(5, 5), (2_000, 2_001), (2_001, 2_000), (None, 7), (8, None)]
    links = chain[::2] + chain[1::2] + star + odd
    out = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert {r["node"]: r["component"] for r in out} == classes(real, {x for p in real for x in p})
    assert len(out) == len({r["node"] for r in out})
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_rank_is_the_order(spark):
    frame = spark.createDataFrame([(f"s{i % 37:02d}{i}",) for i in range(500)] + [(None,)], "s string")
    out = global_rank(frame, "place", F.col("s").isNull(), F.col("s")).collect()
    assert [r["s"] for r in sorted(out, key=lambda r: r["place"])] == sorted(x for x in (r["s"] for r in out) if x) + [None]
    assert sorted(r["place"] for r in out) == list(range(501))


# 4 embeddings

def plain_links(rows, threshold=0.95):
    links = []
    good = {k: np.array(v, float) for k, v in rows.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]):
                if good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold:
                    links.append((a, b))
    return links


def check_vectors(out, rows):
    links = plain_links(rows)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = classes(links, rows)
    got = {r["vec_id"]: r for r in out}
    assert set(got) == set(rows)
    for k in rows:
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (n[k], root[k], root[k] == k), k


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 32))
    rows = {i: (base[i % 40] + 0.1 * rng.standard_normal(32) * (i % 3)).astype("f4").astype(float).tolist() for i in range(400)}
    rows |= {1_000 + i: rows[7] for i in range(5)}  # copies
    rows |= {2_000: None, 2_001: [], 2_002: [0.0] * 32, 2_003: [1.0, None] * 16, 2_004: [float("nan")] * 32, 2_005: [float("inf")] + [1.0] * 31}
    rows |= {3_000: [1.0, 2.0], 3_001: [2.0, 4.0], 3_002: [3.0], 3_003: [-5.0], 3_004: [7.0]}  # other lengths
    frame = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    check_vectors(vectors.near_duplicates(frame, vectors.Search(recall=0.999999)).collect(), rows)


def test_crowded_bucket_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    center = rng.standard_normal(16)
    rows = {i: (center + 0.2 * rng.standard_normal(16)).tolist() for i in range(150)}
    monkeypatch.setattr(vectors, "CHUNK", 20)
    frame = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    check_vectors(vectors.near_duplicates(frame, vectors.Search(recall=0.99999999)).collect(), rows)


def test_repeated_vectors_and_no_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    out = vectors.near_duplicates(frame.withColumn("n", F.lit(1)).withColumn("class", F.lit(2))).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=repr) == [(1, 2, 1), (1, 2, 1), (None, 2, 1)]
    assert vectors.near_duplicates(frame.where("false")).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(6)
    units = vectors.unit(rng.standard_normal((200, 64)))
    near = vectors.unit(units + 0.04 * rng.standard_normal(units.shape))
    true, found, inside = [], [], []
    for seed in range(20):
        signs, factors, _ = vectors.code(units, 8, 8, seed)
        estimate, spread = vectors.estimates(signs, factors, near, seed)
        cosine = (units * near).sum(axis=1)
        true.append(cosine)
        found.append(np.diag(estimate))
        inside.append(np.abs(found[-1] - cosine) <= 5 * spread * np.sqrt(1 - cosine**2))
    assert abs(np.mean(found) - np.mean(true)) < 0.002 and np.mean(inside) > 0.999


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold are the hardest: at least 0.9 of them must be found with the default settings."""
    rng = np.random.default_rng(8)
    one = vectors.unit(rng.standard_normal((600, 64)))
    side = rng.standard_normal((600, 64))
    side = vectors.unit(side - (side * one).sum(axis=1, keepdims=True) * one)
    two = 0.951 * one + (1 - 0.951**2) ** 0.5 * side
    rows = [(2 * i + k, v.tolist()) for i, pair in enumerate(zip(one, two)) for k, v in enumerate(pair)]
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.where("n_links > 0").count() >= 0.93 * 1_200


# 8 chats

@settings(max_examples=400, deadline=None)
@examples(st.sampled_from(["user", "assistant", "system", "", "tool", "użer"]), st.lists(st.sampled_from(
    ["[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "/", "INST]", "s>", "<|61|>", "|>", " ", "\n", "é", "a"]), max_size=12))
def test_every_turn_reads_back(role, parts):
    text = "".join(parts)
    piece, _ = chat.format_turn(role, text)
    found, start, end, stop = chat.parse_turn(piece)
    assert (found, chat.unescape(piece[start:end]), stop) == (role, text, len(piece))
    assert chat.unescape(chat.escape(text)) == text


def plain_digests(rows):
    out, by_conv = {}, defaultdict(list)
    for r in rows:
        by_conv[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv, turns in by_conv.items():
        turns.sort()
        told = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_read_back(spark):
    rows = [tuple(r) for r in given(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))]
    rows += [(-2, 0, "assistant", None), (-2, 0, "assistant", None), (-2, None, None, "x"), (None, 0, "user", ""), (-3, 1, "assistant", "a" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.read_back(chat.format_conversations(frame)).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in out} == plain_digests(rows) and len(out) == len(plain_digests(rows))
    pieces = chat.format_conversations(frame).where("conv_id = -1").collect()
    assert [p["escapes"] for p in pieces] == [1, 1]
    assert chat.read_back(chat.format_conversations(frame.where("false"))).count() == 0


# 9 URLs

@pytest.mark.parametrize("url,host,path,rule", [
    ("http://Www.Example.com:80/en/1?x#y", "www.example.com:80", "/en/1", None),
    ("https://a.WWW.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/"),
    ("https://m.example.com/en/5", "m.example.com", "/en/5", "example.com/en/"),
    ("https://example.com", "example.com", "", None),
    ("https://example.com/EN/5", "example.com", "/EN/5", "com/"),
    ("x://b.net/fr/?q=/es/", "b.net", "/fr/", "net/fr/"),
    ("x://b.net/fr", "b.net", "/fr", None),
    ("x://bnet/fr/", "bnet", "/fr/", None),
    ("x://h?u=a://b.com/", "h", "", None),
    ("no scheme.com/en/", "", "", None), ("", "", "", None), (None, "", "", None),
])
def test_url_rules(spark, url, host, path, rule):
    r = urls.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
    if rule:
        assert r["verdict"] == dict((b, a) for a, b in urls.RULES)[rule]


def test_templates_learn_from_labels(spark):
    """One host: /good/* and /bad/* carry labels of a rule each, and what shares their templates follows."""
    rules = (("block", "h.org/bad/x"), ("allow", "h.org/good/x"))
    rows = [f"http://h.org/{kind}/{mark}{i}" for kind in ("bad", "good") for mark in ("x", "y") for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumn("label", F.lit(3))
    out = {r["page_id"]: r for r in urls.judge(frame, rules).collect()}
    for i, url in enumerate(rows):
        assert out[i]["verdict"] == ("block" if "/bad/" in url else "allow")
        assert out[i]["template"] == ("/bad/*" if "/bad/" in url else "/good/*")
    assert urls.judge(frame.where("false")).count() == 0
    assert {r["verdict"] for r in urls.judge(frame, ()).collect()} == {"allow"}


# SQL counterparts and the pipeline

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        for t in ("documents", "conversations", "pages", "benchmark", "embeddings"):
            db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        sql = db.execute(queries.ORACLES[name])
        columns = [c[0] for c in sql.description]
        want = sql.fetchall()
    got = [tuple(r) for r in queries.REGISTRY[name](spark, sf).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_stages_of_the_pipeline(spark):
    docs, sf = given(spark, "documents"), "/root/testdata/sf0.001"
    language, single, private, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r for r in docs.collect()}

    kept = language(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if re.search(r"[^\W\d_]", r["text"])}

    one = single(spark, docs, sf)
    assert one.columns == docs.columns
    ids = sorted(rows)
    root = plain_groups([rows[k]["text"] for k in ids])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({ids[k] for k in root.values()})

    clean = private(spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert all(not re.search(r"@mail\d", r["text"]) and r["n_chars"] == len(r["text"]) for r in clean.collect())

    blend = mix(spark, docs, sf)
    assert blend.columns == docs.columns
    words = lambda text: len(text.split())
    border = max(words(r["text"]) for r in rows.values()) / 2  # a source is off by half a document at most
    copies, sources = blend.collect(), {r["source"] for r in rows.values()}
    assert all(r["text"] == rows[r["doc_id"]]["text"] for r in copies)
    off = sum(words(r["text"]) for r in copies) - 1.5 * sum(words(r["text"]) for r in rows.values())
    assert abs(off) <= len(sources) * (border + 1)

    out = pack(spark, docs, sf).collect()
    assert {r["doc_id"] for r in out} == set(rows)


def test_language_needs_evidence(spark):
    """Symbols and numbers around a letter go, also without labels; clean rows that the network never saw stay."""
    docs = given(spark, "documents")
    clean = {r["doc_id"]: r for r in docs.collect()}
    odd = ["= 12 + 34 * 56 / 78 - x", "0123456789 " * 400 + "a", "....", "", None, "\u4e2d\u6587 1", "\u0928\u092e\u0938\u094d\u0924\u0947"]
    added = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.unionByName(added, allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, both, "").collect()}
    assert kept >= set(clean) and not kept & {10**9 + i for i in range(5)}
    bare = both.withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, bare, "").collect()}
    assert kept == set(clean) | {10**9 + 5, 10**9 + 6}


def test_pipeline_of_odd_and_no_rows(spark):
    for docs in (odd_docs(spark), no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = stage(spark, docs, "")
            if name != "packing":
                assert docs.columns == before.columns
        docs.count()


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = out.collect()
    assert rows and all(r["offset"] + r["length"] <= packing.SEQUENCE for r in rows)
    assert langid.UNDETERMINED not in {r["doc_id"] for r in rows}

"""The pipeline's near copies against brute-force shingle similarity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bidmatrix.llm import nearcopies, simhash
from bidmatrix.session import stored
from llm_helpers import given, no_docs, odd_docs, plain_groups


def kept_ids(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect())


def test_stage_against_all_pairs(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in given(spark, "documents", "sf0.01").collect())
    root = plain_groups([t for _, t in rows])
    assert kept_ids(spark, rows) == sorted({rows[r][0] for r in root.values()})


@pytest.mark.parametrize("with_base", (True, False))
def test_crowded_buckets(spark, monkeypatch, with_base):
    """Many variants of one text: chunks of a few nodes must connect what all pairs connect."""
    monkeypatch.setattr(nearcopies, "CHUNK", 8)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)] if with_base else []
    for k in range(120):
        words = list(base)
        for at in rng.integers(0, 150, 1 + k % 5):
            words[at] = f"x{rng.integers(3)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    assert kept_ids(spark, rows) == sorted(set(plain_groups(texts).values()))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 6, 7, 8]
    assert nearcopies.keep_one(no_docs(spark)).count() == 0


def test_fingerprints_bring_candidates(spark):
    """Without any min-hash table, near copies within op3's two bits still meet; those below 0.8 do not link."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join(f"v{i}" for i in range(90)), " ".join(["start", *base])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = nearcopies.prints(docs)
    assert {r["doc_id"]: r["fp"] for r in found.collect()} == {r["doc_id"]: r["fp"] for r in simhash.fingerprints(docs).collect()}
    bare = found.withColumn("keys", F.array().cast("array<bigint>"))
    node = {r["doc_id"]: r["node"] for r in found.collect()}
    bits = {k: r["fp"] for k, r in {r["doc_id"]: r for r in found.collect()}.items()}
    near = [(a, b) for a in range(4) for b in range(a) if ((bits[a] ^ bits[b]) & (2**64 - 1)).bit_count() <= 2]
    assert near and all(2 not in p for p in near)
    got = nearcopies.links(docs, stored(bare.select("node", "mark", "keys", "fp"))).collect()
    linked = {frozenset((r["one"], r["other"])) for r in got}
    assert linked and all(frozenset(node[x] for x in p) in linked for p in near[:1])

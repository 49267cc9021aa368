"""Language, licences, SimHash, packing, mixing, pseudonyms and sketches against plain versions of themselves."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bidmatrix.llm import langid, licenses, mixing, packing, pii, simhash, sketches, tokens
from llm_helpers import LONG, ODD, given, no_docs, odd_docs


def classes(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    return {n: find(n) for n in nodes}


# 1 language

def test_language_of_rows_never_learned_from(spark):
    docs = given(spark, "documents", "sf0.01")
    out = langid.identify(docs, langid.fit(docs)).withColumn("held_out", langid.held_out(F.col("doc_id"))).collect()
    unseen = [r for r in out if r["held_out"]]
    assert len(out) == docs.count() and len(unseen) > 200
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in out)
    assert np.mean([r["lang_pred"] == r["lang"] for r in unseen]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark)
    out = langid.identify(docs, langid.fit(given(spark, "documents"))).collect()
    assert len(out) == len(ODD)
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == langid.UNDETERMINED) == (not letters)
    assert langid.identify(no_docs(spark), langid.fit(no_docs(spark))).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(unlabelled)).collect()} == {"und"}


def test_applied_tables_give_the_trained_network():
    rng = np.random.default_rng(0)
    windows = rng.integers(97, 123, (300, langid.WINDOW)).astype(np.uint8)
    network = langid.train(windows, ["x" if w[0] < 110 else "y" for w in windows], langid.Training(steps=5))
    w, pooled = network.weights, []
    for k in langid.WIDTHS:
        embedded = w["bytes"][windows]
        n = langid.WINDOW - k + 1
        pooled.append(sum(embedded[:, j : j + n] @ w[f"filter{k}"][j] for j in range(k)).max(axis=1) + w[f"bias{k}"])
    plain = langid.softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ w["out"] + w["offset"])
    assert np.allclose(langid.Applied(network).shares(windows), plain, atol=1e-4)


# 2 licences

def test_licences_against_a_plain_count(spark):
    docs = given(spark, "documents", "sf0.01").unionByName(odd_docs(spark), allowMissingColumns=True)
    got = licenses.scan(docs).collect()
    want = []
    for r in docs.collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        words = re.findall(licenses.WORD, low)
        places = [
            (i, label) for phrase, label in licenses.BASE for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        ]
        at = [i for i, _ in places]
        want.append((r["doc_id"], len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(no_docs(spark)).count() == 0


@pytest.mark.parametrize("text,labels", [
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("Lizenz: GNU Lesser General Public License v2.1 or later", {"gpl", "lgpl-2.1"}),
    ("(c) CC BY-NC-SA 4.0", {"cc-by", "cc-by-nc-sa"}),
    ("SPDX-License-Identifier: MIT", {"mit"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction", {"mit"}),
    ("mit dem Hund", set()),
])
def test_licence_labels(text, labels):
    assert set(filter(None, licenses.scan_text(text.encode())[5].split(","))) == labels


def test_hundreds_of_rules_each_with_a_keyword_of_its_own_matches():
    rules = licenses.rules()
    assert len(rules) > 300 and all(len(word.strip()) >= 3 for word, *_ in rules)


def test_contained_hits_go():
    hits = [(0, 10, licenses.NAMED, "short"), (0, 20, licenses.NAMED, "long"), (5, 30, licenses.TEXT, "text"), (6, 9, licenses.TEXT, "part")]
    assert [h[3] for h in licenses.resolve(hits)] == ["text", "long"]


# 3 SimHash

def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def check_components(rows):
    """rows of doc_id, fingerprint, component_id, every pair of fingerprints compared."""
    prints = sorted({r["fingerprint"] for r in rows})
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i:] if (int(a, 16) ^ int(b, 16)).bit_count() <= 2]
    root, least = classes(pairs, prints), {}
    for r in rows:
        if r["doc_id"] is not None:
            k = root[r["fingerprint"]]
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert [r["component_id"] for r in rows] == [least.get(root[r["fingerprint"]]) for r in rows]


def test_simhash_against_all_pairs(spark):
    docs = given(spark, "documents", "sf0.01").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    out = simhash.near_duplicates(docs).collect()
    want = sorted(((r["doc_id"], f"{plain_fingerprint(r['text']):016x}") for r in docs.collect()), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"]) for r in out), key=repr) == want
    check_components(out)
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


def test_masks_cover_every_pair_of_bits():
    masks = [m & (2**64 - 1) for m in simhash.masks()]
    for i in range(64):
        for j in range(64):
            assert any(not (m >> i & 1 or m >> j & 1) for m in masks)


def test_simhash_of_a_crowded_bucket(spark):
    """300 fingerprints that agree in most tables: the linear way must connect what all pairs connect."""
    rng = np.random.default_rng(5)
    spots = [1 << int(b) for b in rng.integers(0, 64, 12)]
    prints = {0}
    while len(prints) < 300:
        prints.add(sorted(prints)[int(rng.integers(len(prints)))] ^ spots[int(rng.integers(12))] ^ (1 << int(rng.integers(64))))
    nodes = sorted(simhash._signed(p) for p in prints) + [simhash._signed(0x0F0F0F0F0F0F0F0F)]
    frame = spark.createDataFrame([(n,) for n in nodes], "fp long")
    links = [(r["fp"], r["near"]) for r in simhash.links(frame).collect()]
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    assert classes(links, nodes) == classes(pairs, nodes)


def test_one_of_each_group_stays(spark):
    docs = odd_docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 6, 7, 8]


# 5 packing

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


PARTS = [*"ab'sléÉß×÷ɏɐ中😀 \t\n \u0085\x1c\x0b0²9_.,<|>", "<|endoftext|>", "'ll", " the", "'S"]


@settings(max_examples=400, deadline=None)
@examples(parts=st.lists(st.sampled_from(PARTS), max_size=40))
def test_ids_are_the_librarys(library, parts):
    text = "".join(parts)
    assert np.frombuffer(tokens.encoder().ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_keeps_every_token_in_its_place(spark, library):
    docs = given(spark, "documents", "sf0.01").select("doc_id", "text").unionByName(odd_docs(spark).where("doc_id != 5").select("doc_id", "text"))
    docs = docs.withColumn("doc_id", F.monotonically_increasing_id())
    rows = docs.collect()
    out = packing.pack_documents(docs).collect()
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
    total = 0
    for row in rows:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        at = 0
        for n, piece in enumerate(sorted(by_doc[row["doc_id"]], key=lambda r: r["piece"])):
            assert piece["piece"] == n and piece["start"] == at
            own = np.array(ids[at : at + piece["length"]], "<u4").tobytes()
            assert zlib.crc32(own) == piece["ids_crc32"]
            assert piece["length"] == 2048 or n == 0
            at += piece["length"]
        assert at == len(ids)
    used = defaultdict(list)
    for r in out:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in used.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= -(-total // 2048) + 1
    assert packing.pack_documents(no_docs(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@examples(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_each_length_once(counts):
    rows = packing.plan_sequences(counts, 64)
    placed, fill = Counter(), defaultdict(list)
    for length, rank, n, first, at in rows:
        assert rank == placed[length]
        placed[length] += n
        for k in range(n):
            fill[first + k].append((at, length))
    assert placed == Counter(counts)
    for spots in fill.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 64


# 6 mixing

def test_mixing_meets_targets(spark):
    for docs in (given(spark, "documents", "sf0.01"), odd_docs(spark)):
        out = mixing.mix_documents(docs)
        assert set(docs.columns) | set(mixing.ADDED) == set(out.columns)
        rows = out.collect()
        assert rows and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
        per = defaultdict(int)
        for r in rows:
            per[r["source"]] += r["taken"]
        targets = {r["source"]: r["target"] for r in rows}
        assert all(abs(per[s] - targets[s]) <= 1 for s in per)
        words = sum(r["size"] for r in rows)
        assert abs(sum(targets.values()) - 1.5 * words) < 1e-6 * max(1, words)
        assert sorted(map(tuple, mixing.mix_documents(docs).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
        copies = Counter((r["doc_id"], r["source"], r["text"]) for r in mixing.repeat_documents(out).collect())
        wanted = Counter()
        for r in rows:
            if r["size"]:
                wanted[r["doc_id"], r["source"], r["text"]] += r["taken"] // r["size"] + (2 * (r["taken"] % r["size"]) >= r["size"])
        assert copies == +wanted
    assert mixing.mix_documents(no_docs(spark)).count() == 0


def test_border_like_a_plain_order(spark):
    """Whole documents in the order of their hash, in several buckets a source, with repeated and null ids."""
    docs = spark.createDataFrame(
        [(None if i % 50 == 0 else i - i % 2 if i % 90 == 1 else i, "w " * (i % 9), None if i % 4 == 0 else f"s{i % 4}") for i in range(2_000)],
        "doc_id long, text string, source string",
    )
    rows = mixing.mix_documents(docs, mixing.Mix(bucket_rows=60)).collect()
    draw = lambda r: hashlib.md5(f"mix-1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
    for source in {r["source"] for r in rows}:
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (draw(r), r["size"]))
        words, size = math.floor(own[0]["target"] + 0.5), own[0]["source_size"]
        assert size == sum(r["size"] for r in own)
        left, wanted = words % size, []
        for r in own:
            wanted.append((draw(r), r["size"], words // size * r["size"] + min(left, r["size"])))
            left -= min(left, r["size"])
        assert sorted(wanted) == sorted((draw(r), r["size"], r["taken"]) for r in own)


def test_border_buckets(spark):
    """Many buckets per source, so that the border lies inside one of them."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(3_000)], "doc_id long, text string, source string")
    rows = mixing.mix_documents(docs, mixing.Mix(bucket_rows=50)).collect()
    per, targets = defaultdict(int), {r["source"]: r["target"] for r in rows}
    for r in rows:
        per[r["source"]] += r["taken"]
    assert all(abs(per[s] - targets[s]) <= 1 for s in per)


# 7 pseudonyms

def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], r["n_found"]) for r in pii.pseudonymise(docs).orderBy("doc_id").collect()]


def test_pseudonyms_keep_the_format(spark):
    texts = [
        "card 4111 1111 1111 1111", "4111111111111111 9807915762804490", "on 1984-02-29 and 31/12/1999", "from 97.51.17.173",
        "DE89 3704 0044 0532 0130 00", "call +1 (017) 555-7713.", "id 123-45-6789", "to ci.34@mail7.example.com.",
        'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"',
    ]
    out = replaced(spark, texts)
    layout = lambda s: re.sub("[0-9]", "9", s)
    for (new, n), old in zip(out, texts):
        assert n >= 1 and new != old
        if "@" not in old and "token" not in old and "97." not in old:
            assert layout(new) == layout(old)
    assert luhn(out[0][0]) and out[1][0].endswith(" 9807915762804490") and luhn(out[1][0].split()[0])
    assert re.sub(" ", "", out[0][0][5:]) == out[1][0].split()[0]  # linked whatever the layout
    bank = re.sub(" ", "", out[4][0])
    assert int("".join(str(int(c, 36)) for c in bank[4:] + bank[:4])) % 97 == 1


def test_what_does_not_check_out_stays(spark):
    texts = ["4111111111111112", "999.1.1.1", "2001-13-45", "000-12-3456", "version 2.0 of 2020", "GB82WEST12345698765433", "", None, "page 12345", LONG]
    assert replaced(spark, texts) == [(t, 0) for t in texts]


def test_feistel_permutes(spark):
    numbers = spark.range(1_000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("n"))
    fresh = [r[0] for r in numbers.select(pii.permute_digits(F.col("n"), pii.Key(), "x")).collect()]
    assert sorted(fresh) == [f"{i:03d}" for i in range(1_000)]
    days = spark.range(pii._CYCLE).select(F.expr("date_add(date'1800-01-01', cast(id as int))").alias("d"))
    assert days.select(pii.permute_day(F.col("d"), pii.Key()).alias("p")).agg(F.count_distinct("p"), F.min("p").cast("string"), F.max("p").cast("string")).first() == (pii._CYCLE, "1800-01-01", "2199-12-31")


def test_pseudonyms_of_odd_rows(spark):
    docs = odd_docs(spark)
    out = pii.pseudonymise(docs).collect()
    assert sorted((r["text"] or "") for r in out) == sorted((r[1] or "") for r in ODD)
    assert pii.pseudonymise(no_docs(spark)).count() == 0


# 10 sketches

def plain_sketch(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints_against_plain_sets(spark):
    docs = given(spark, "documents").select("doc_id", "text").unionByName(odd_docs(spark).where("doc_id is not null and doc_id != 5").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    out = {r["doc_id"]: r for r in sketches.compare_edited(docs).collect()}
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    errors = []
    for k, (doc_id, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = out[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for column, other in (("near_edited", edited), ("near_next", after)):
            a, b = plain_sketch(text), plain_sketch(other)
            likeness = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= r[column] <= 1
            if len(a | b) <= sketches.K:
                assert abs(r[column] - likeness) < 1e-9
            errors.append(r[column] - likeness)
        if len(plain_sketch(text)) < sketches.K:
            assert r["distinct_shingles"] == len(plain_sketch(text))
    assert len(out) == len(texts) and np.abs(errors).mean() < 0.01 and np.abs(errors).max() < 0.2
    by_text = defaultdict(set)
    for doc_id, text in texts:
        by_text[text].add(out[doc_id]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_sketches_merge(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = spark.createDataFrame([("x", words(0, 700)), ("x", words(600, 1_500)), ("y", words(0, 300))], "key string, text string")
    parts = rows.withColumn("own", sketches.sketch(F.col("text")))
    merged = {r["key"]: r["own"] for r in sketches.merge_all(parts, ["key"], "own").collect()}
    whole = spark.createDataFrame([("x", words(0, 1_500)), ("y", words(0, 300))], "key string, text string")
    sketched = {r[0]: r[1] for r in whole.select("key", sketches.sketch(F.col("text"))).collect()}
    assert len(merged["x"]) == sketches.K and len(set(merged["x"]) & set(sketched["x"])) >= sketches.K - 2
    assert merged["y"] == sketched["y"]
    both = parts.where("key = 'y'").select(
        sketches.containment(F.col("own"), F.array(*[F.lit(h) for h in sketched["x"]])).alias("c"), sketches.distinct_shingles(F.col("own")).alias("n")
    ).first()
    assert both["c"] > 0.7 and abs(both["n"] - 296) < 90


def test_sketches_of_odd_rows(spark):
    assert sketches.compare_edited(odd_docs(spark)).count() == len(ODD)
    assert sketches.compare_edited(no_docs(spark)).count() == 0

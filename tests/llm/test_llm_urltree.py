"""Verdicts of pages without a rule against a plain tree of path templates."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bidmatrix.llm import urls


def plain_verdicts(rows, rules, tree=urls.Tree()):
    """rows of (page_id, url) to page_id -> (verdict, template, purity)."""
    pages = []
    for key, url in rows:
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [
            (len(r), verdict) for verdict, r in rules
            if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])
        ]
        label = max(fits)[1] if fits else None
        pages.append((key, host, label, (path[1:] if path.startswith("/") else path).split("/")))

    places = defaultdict(Counter)
    for _, host, _, parts in pages:
        for at, part in enumerate(parts):
            if not any(c in "0123456789" for c in part):
                places[host, at][part] += 1
    stays = {
        (host, at, part) for (host, at), found in places.items() for part, n in found.items()
        if len(found) <= tree.few_values or n >= sum(found.values()) * tree.rare_share
    }
    chains, label_of = {}, {}
    counts = defaultdict(lambda: [0, 0])
    for key, host, label, parts in pages:
        made = [p if (host, at, p) in stays else "*" for at, p in enumerate(parts)]
        begin = lambda n: "/" + "/".join(made[:n])
        names = host.split(".")
        chain = (names[-1], ".".join(names[-2:]), host, begin(1), begin(2), begin(len(made)))
        chains.setdefault(chain, []).append(key)
        label_of[key] = label
        for depth in range(len(chain) + 1):
            node = counts[chain[:depth]]
            node[0] += label is not None
            node[1] += label == "block"

    merged = {node: tuple(c) for node, c in counts.items()}
    families = defaultdict(lambda: defaultdict(list))
    for node, (n, x) in merged.items():
        if len(node) > 3 and n:
            families[node[:-1]][x / n, n].append(node)
    for family in families.values():
        clusters, last = [], None
        for share, n in sorted(family):
            group = family[share, n]
            now = sum(counts[g][0] for g in group), sum(counts[g][1] for g in group)
            if last:
                both = (now[1] + last[1] + 1) / (now[0] + last[0] + 2)
                error = math.sqrt(both * (1 - both) * (1 / now[0] + 1 / last[0]))
            if last is None or abs(now[1] / now[0] - last[1] / last[0]) > tree.same_z * error:
                clusters.append([])
            clusters[-1] += group
            last = now
        for cluster in clusters:
            total = tuple(sum(counts[g][i] for g in cluster) for i in (0, 1))
            merged.update(dict.fromkeys(cluster, total))

    purity = {(): (counts[()][1] + 1) / (counts[()][0] + 2)}
    for node in sorted(counts, key=len):
        if node:
            (n, x), above = merged[node], purity[node[:-1]]
            same = n == 0 or n == counts[node[:-1]][0]
            purity[node] = above if same else (x + tree.prior_pages * above) / (n + tree.prior_pages)
    return {
        key: (label_of[key] or ("block" if purity[chain] >= tree.block_share else "allow"), chain[-1], purity[chain])
        for chain, keys in chains.items() for key in keys
    }


def assert_like_plain(frame, rules=urls.RULES):
    out = urls.judge(frame, rules).collect()
    wanted = plain_verdicts([(r["page_id"], r["url"]) for r in frame.collect()], rules)
    assert len(out) == frame.count()
    for r in out:
        verdict, template, purity = wanted[r["page_id"]]
        assert (r["verdict"], r["template"]) == (verdict, template)
        assert r["purity"] == pytest.approx(purity, abs=1e-12)
    return out


def test_given_pages_like_a_plain_tree(spark):
    out = assert_like_plain(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert any(r["verdict"] == "block" for r in out if r["rule"] is None)
    assert any(r["verdict"] == "allow" for r in out if r["rule"] is None)


def test_deep_and_mixed_tree_like_a_plain_one(spark):
    """Branches of one parent apart and alike, rare and many segments, ports, repeated pages, a path of 3,000 segments."""
    rules = (("block", "a.org/bad/"), ("allow", "a.org/good/"), ("block", "org/x/"), ("allow", "b.net/x/"))
    made = [f"http://{h}/{s}/{t}{i % 7}/{u}" for i in range(40) for h in ("a.org", "m.a.org", "b.net", "c.b.net:81")
            for s in ("bad", "good", "x", "other") for t in ("p", "q") for u in ("end", f"n{i}")]
    made += [f"http://a.org/w{'abcdefghijklmnopqrstuvwxyz'[i % 26] * (i % 5 + 1)}/k" for i in range(300)]
    made += ["http://a.org/x/" + "s/" * 3000, None, "", "none", "http:///x", "http://a.org", "http://a.org?y", "http://A.org/bad//"]
    made += [f"http://c.org/{s}/{i}" for s in ("x", "other") for i in range(60)]
    rows = list(enumerate(made)) + [(0, made[0])] * 3
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumn("purity", F.lit("clash")).withColumn("first", F.lit(1))
    out = assert_like_plain(frame, rules)
    assert {r["verdict"] for r in out if r["rule"] is None} == {"allow", "block"}


def test_pages_without_labels_follow_their_parents(spark):
    """A host whose labelled pages are all blocked blocks its other pages; a new host follows its domain."""
    made = [f"http://h{i % 3}.bad.net/es/{i}" for i in range(90)] + [f"http://h.good.com/es/{i}" for i in range(90)]
    made += ["http://h1.bad.net/en/7", "http://new.bad.net/en/7", "http://h.good.com/de/7", "http://other.org/en/1"]
    out = urls.judge(spark.createDataFrame(list(enumerate(made)), "page_id long, url string")).collect()
    assert [r["verdict"] for r in sorted(out, key=lambda r: r["page_id"])][-4:] == ["block", "block", "allow", "allow"]

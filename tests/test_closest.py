"""The segment index against comparing every label with every entry."""

import random
import re

import pytest

import bidmatrix.operators.closest as closest_module
from bidmatrix.operators import conformance
from bidmatrix.operators.closest import RINGS, _in_bank, candidates, closest
from conftest import rows
from workload import views

SERVICE = "service_category string, sub_service string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def normal(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip(" ")


def plain(labels, bank):
    known = {c for c, n in bank if c is not None and n is not None}
    out = []
    for category, label in set(labels):
        met = [(distance(normal(label), normal(n)), n, c) for c, n in bank
               if label is not None and c is not None and n is not None and (c == category or category not in known)]
        best = min(met, default=(None, None, None))
        out.append((category, label, best[2], best[1], best[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_closest_entries_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda least, most: "".join(rng.choice("aab c-") for _ in range(rng.randint(least, most)))
    bank = [(rng.choice("PQ"), word(0, 14)) for _ in range(40)] + [("P", "b" * 30), ("R", "same"), ("S", "same"), (None, "x"), ("P", None)]
    labels = [(rng.choice(["P", "Q", "X", None]), word(0, 16)) for _ in range(80)]
    labels += [("P", "b" * 29), ("P", "B" * 26 + "a"), ("X", "same"), ("P", None), (None, None), ("P", "b" * 29)]
    got = closest(spark.createDataFrame(labels, SERVICE), spark.createDataFrame(bank, SERVICE))
    assert rows(got, "service_category", "sub_service", "snapped_category", "snapped", "distance") == plain(labels, bank)


def test_empty_banks_and_labels(spark):
    labels, none = spark.createDataFrame([("P", "a"), (None, None)], SERVICE), spark.createDataFrame([], SERVICE)
    assert rows(closest(labels, none), "sub_service", "snapped", "distance") == [("a", None, None), (None, None, None)]
    assert closest(none, labels).count() == 0


def test_the_index_compares_few_pairs(spark):
    """Entries that share no long piece do not meet."""
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(16)) for _ in range(300)]
    labels, entries = _in_bank(spark.createDataFrame([("P", n[:5] + n[6:]) for n in names], SERVICE), spark.createDataFrame([("P", n) for n in names], SERVICE))
    assert sum(candidates(labels, entries, r).count() for r in RINGS[:2]) < 0.02 * 300 * 300


def test_uncovered_entries_in_blocks(spark, frame):
    bank = [("C", f"s{i}") for i in range(200)] + [("D", "s0"), ("D", "s0"), ("E", None)]
    cells = [("s", "A", "C", f"s{i}", 1) for i in range(0, 200, 3)] + [("t", "A", "D", "s0", 1), ("t", "A", "X", "s1", 1)]
    got = conformance.uncovered(frame(cells), spark.createDataFrame(bank, SERVICE))
    quoted = {s: {(c, n) for x, _, c, n, _ in cells if x == s} for s in "st"}
    assert rows(got, "session_id", "service_category", "sub_service") == sorted(
        ((s, c, n) for s in "st" for c, n in set(bank) - quoted[s]), key=repr)


def test_a_common_piece_is_met_in_chunks(spark, monkeypatch):
    """Entries that share a long piece come in chunks; the index is not broadcast, and no pair is shuffled."""
    monkeypatch.setattr(closest_module, "CHUNK", 7)
    rng = random.Random(5)
    tail = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(5))
    bank = [("P", f"common part {tail()}") for _ in range(60)]
    labels = [("P", f"common part {tail()}") for _ in range(15)] + [("X", f"comon part {tail()}") for _ in range(10)]
    given, entries = spark.createDataFrame(labels, SERVICE), spark.createDataFrame(bank, SERVICE)
    got = closest(given, entries)
    assert rows(got, "service_category", "sub_service", "snapped_category", "snapped", "distance") == plain(labels, bank)
    text = candidates(*_in_bank(given, entries), 1)._jdf.queryExecution().executedPlan().toString()
    assert "chunk" in text and "Broadcast" not in text and text.index("SortMergeJoin") < text.index("Aggregate")

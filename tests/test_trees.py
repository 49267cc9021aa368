"""Walks over the tree of texts against comparing all pairs."""

import random

import pytest

from bidmatrix.operators import trees
from bidmatrix.operators.closest import _in_bank, candidates
from test_closest import SERVICE, distance


@pytest.mark.parametrize("seed", range(12))
def test_nearest_texts_are_those_of_all_pairs(seed, monkeypatch):
    monkeypatch.setattr(trees, "STEP", 50)
    monkeypatch.setattr(trees, "SETTING_OUT", 7)
    rng = random.Random(seed)
    word = lambda least, most: "".join(rng.choice("aabc é😀") for _ in range(rng.randint(least, most)))
    labels, texts = [word(0, 12) for _ in range(30)] + ["b" * 40], [word(0, 12) for _ in range(rng.randint(1, 40))] + ["b" * 39, "b" * 70][: seed % 3]
    for radius in (1, 2, 4, 6):
        near = {label: min(distance(label, t) for t in texts) for label in set(labels)}
        expected = sorted((label, t) for label, d in near.items() for t in set(texts) if distance(label, t) == d <= radius)
        assert sorted(zip(*trees.nearest(labels, texts, radius))) == expected


def test_entries_with_a_common_piece_are_not_all_met(spark):
    """Many entries share a long piece with every label: only the closest are brought together with it."""
    bank = [("P", f"common part {i:05x}") for i in range(1, 4000, 13)]
    labels = [("P", f"common part {i:05x}z") for i in range(1, 4000, 13)]
    pairs = candidates(*_in_bank(spark.createDataFrame(labels, SERVICE), spark.createDataFrame(bank, SERVICE)), 1)
    assert pairs.count() == len(bank)

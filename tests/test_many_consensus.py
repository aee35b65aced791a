"""Longest common substrings of many pairs at a time."""

import random

from panweave.functions import transcripts as T


def test_many_pairs_give_what_single_ones_give(monkeypatch):
    rng = random.Random(3)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    firsts = [text(rng.randint(1, 40), "AC*" if k % 3 == 0 else "ACGT") for k in range(300)] + [text(900, "ACGT"), "é😀A"]
    seconds = [text(rng.randint(1, 40), "ACN" if k % 4 == 0 else "ACGT") for k in range(300)] + [text(1100, "ACGT"), "x😀A"]
    want = [T.longest_common(a, b, True) for a, b in zip(firsts, seconds, strict=True)]
    assert T.longest_common_of(firsts, seconds) == want
    monkeypatch.setattr(T, "CELLS", 1200)  # small batches, and long pairs on their own
    assert T.longest_common_of(firsts, seconds) == want
    assert T.longest_common_of([], []) == []


def test_a_small_file_of_predictions_is_many_tasks(spark):
    pairs = spark.createDataFrame([(i, "ACGT" * 10, "ACGT" * 9) for i in range(500)], "id long, first string, second string").coalesce(1)
    assert T.consensus_of(pairs).rdd.getNumPartitions() == 4  # one before

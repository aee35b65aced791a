"""The near-dedup stage against brute force at a similarity of 0.8 over shingles of five words."""

import random

import corpus_pipeline
from tests.llm.conftest import make, words
from tests.llm.test_minhash import chains, shingles


def kept(rows, percent=80):
    sets, left, out = {d: shingles(t) for d, t, *_ in rows}, {d for d, *_ in rows}, set()
    while left:
        seen = todo = {min(left)}
        while todo:
            todo = {b for a in todo for b in left - seen if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
            seen = seen | todo
        left -= seen
        out.add(min(seen))
    return sorted(out)


def between(groups=30):
    """Pairs with a similarity in [0.8, 0.85): one of 52 words is replaced, 43 of 53 shingles are common; a third at 0.72."""
    rng, rows = random.Random(3), []
    for g in range(groups):
        w = words(rng, 52, 100_000).split()
        other, third = list(w), list(w)
        other[20] = third[8] = "x1"
        third[30] = "x2"
        rows += [(10 * g + k, " ".join(t), "en", "a") for k, t in enumerate((w, other, third))]
    return rows


def test_pairs_from_080_on_are_copies(spark):
    rows = between()
    a, b, c = (shingles(r[1]) for r in rows[:3])
    assert 80 <= 100 * len(a & b) / len(a | b) < 85 and 100 * len(a & c) / len(a | c) < 80
    want = kept(rows)
    assert len(want) == 60 and len(kept(rows, 85)) == 90
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, make(spark, rows), "").collect()) == want


def test_chains_match_brute_force(spark):
    rows = list({r[0]: r for r in chains(4)}.values())
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, make(spark, rows), "").collect()) == kept(rows)


def test_one_id_with_unlike_texts_keeps_both(spark):
    rng = random.Random(6)
    a, b, c = (words(rng, 60, 10_000) for _ in range(3))
    rows = [(7, a, "en", "s"), (7, b, "en", "s"), (9, a, "de", "s"), (7, a, "de", "t"), (7, a, "de", "t"), (None, a, "en", "s"), (None, a, "en", "s"), (3, b + " x", "en", "s"), (4, c, "en", "s"), (5, "", "en", "s"), (5, None, "en", "s")]
    out = corpus_pipeline.near_dedup(spark, make(spark, rows), "")
    assert out.columns == make(spark, rows).columns
    got = sorted(((r["doc_id"], r["text"], r["lang"]) for r in out.collect()), key=str)
    assert got == sorted([(7, a, "de"), (None, a, "en"), (None, a, "en"), (3, b + " x", "en"), (4, c, "en"), (5, "", "en"), (5, None, "en")], key=str)

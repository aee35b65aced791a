"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from panweave.llm import periodic
from tests.llm.conftest import make


def plain_runs(w, min_length=24, min_power=3):
    least = {}
    for q in range(1, len(w) // min_power + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(min_length, min_power * q):
                least.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in least.items())


def plain(doc_id, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and w:
        g, a = h // 10, h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)), len(w), len(gone))


def some_texts():
    rng = random.Random(5)
    word = lambda v: f"w{rng.randrange(v)}é"
    fib = ["a", "b"]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    out = [None, "", " \t\n", "one", "a " * 500, "a b " * 300, " ".join(fib[-1]), "x" * 5000, "ab cd " * 30, "tab\tline\nff\x0cvt\x0bcr\r " * 12, "same\x00word " * 40, "A a " * 20]
    for _ in range(60):
        unit = [word(rng.choice([2, 5, 400])) for _ in range(rng.randrange(1, 60))]
        out.append(" ".join([word(9) for _ in range(rng.randrange(40))] + unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))] + [word(9) for _ in range(rng.randrange(40))]))
    return out


@pytest.mark.parametrize("plant", [None, periodic.planted], ids=["as_is", "planted"])
def test_documents_are_brute_force(spark, edge, plant):
    rows = [(i, t, "en", "a") for i, t in enumerate(some_texts())] + [(3, "b c " * 50, "en", "a"), (3, "b c " * 50, "en", "a"), (None, "b c d " * 50, None, None), (-70, "q r s t " * 50, None, None)]
    docs = make(spark, rows).unionByName(edge.filter("length(text) < 20000 OR text IS NULL"))
    got = periodic.periodic_runs(docs, plant=plant, chunk_bytes=3000)
    want = Counter(plain(r["doc_id"], r["text"], plant) for r in docs.select("doc_id", "text").collect())
    assert Counter(tuple(r) for r in got.collect()) == want
    assert [c for c, _ in got.dtypes][:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_empty_table(spark, empty):
    assert periodic.periodic_runs(empty, plant=periodic.planted).count() == 0


def coded(docs, vocabulary):
    t, doc, first = [len(docs) * (vocabulary + 1)], [len(docs)], []
    for k, w in enumerate(docs):
        first.append(len(t))
        t += [k * (vocabulary + 1) + x for x in w] + [k * (vocabulary + 1) + vocabulary]
        doc += [k] * (len(w) + 1)
    return np.array(t), np.array(doc), first


@pytest.mark.parametrize("seed", range(4))
def test_small_alphabets_and_other_limits(seed):
    rng = random.Random(seed)
    for _ in range(80):
        docs = [[rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(90))] for _ in range(rng.randrange(1, 5))]
        limits = rng.choice([(24, 3), (6, 3), (4, 2), (1, 2), (3, 4)])
        t, doc, first = coded(docs, 3)
        start, length, period = periodic.runs_of(t, doc, *limits)
        got = [sorted((int(s) - first[k], int(n), int(q)) for s, n, q in zip(start, length, period, strict=True) if 0 <= s - first[k] < len(w)) for k, w in enumerate(docs)]
        assert got == [plain_runs(w, *limits) for w in docs]


def test_long_texts_stay_nearly_linear():
    """Deep trees: one word, a short and a long period, 200,000 words each."""
    rng = random.Random(9)
    unit = [rng.randrange(300) for _ in range(1000)]
    for w, q in (([0] * 200_000, 1), (list(range(7)) * 28_571, 7), (unit * 200, 1000)):
        t, doc, _ = coded([w], 300)
        assert [x.tolist() for x in periodic.runs_of(t, doc)] == [[1], [len(w)], [q]]


def test_leaves_listed_are_n_log_n():
    """The smaller-half rule on a text of one word: a path of a tree, so one leaf a node is listed."""
    t, doc, _ = coded([[0] * 4096], 1)
    sa, _ = periodic.suffixes(t, doc, 16)
    begin, period = periodic.branching_repeats(t, sa, False)
    assert len(begin) == 2048 and (begin + 2 * period == 4097).all()


def test_two_periods_are_the_least(spark, empty):
    with pytest.raises(ValueError):
        periodic.periodic_runs(empty, min_power=1)

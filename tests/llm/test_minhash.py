import random
import re

import numpy as np
import pyarrow as pa

from panweave.llm import _text, minhash
from tests.llm.conftest import edge_rows, make, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(d, shingles(t)) for d, t, *_ in rows]
    out = []
    for d, t, *_ in rows:
        n = len(shingles(t))
        if d is None:
            out.append((None, n, None, True))
            continue
        first = shingles(t)
        seen, todo = {i for i, (e, s) in enumerate(sets) if e == d and s == first}, [first]
        while todo:
            a = todo.pop()
            for i, (e, s) in enumerate(sets):
                if i not in seen and e is not None and a and s and 100 * len(a & s) >= 85 * len(a | s):
                    seen.add(i)
                    todo.append(s)
        least = min(sets[i][0] for i in seen)
        out.append((d, n, least, d == least))
    return sorted(out, key=str)


def result(df, **options):
    return sorted([tuple(r)[:4] for r in minhash.near_duplicates(df, **options).collect()], key=str)


def chains(seed, groups=25, copies=12):
    """Groups whose members are edited from one another, so that links form chains and most pairs lie below the limit."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        w = words(rng, rng.choice((30, 80, 200)), 100_000).split()
        for _ in range(rng.randrange(1, copies)):
            rows.append((rng.randrange(10**9), " ".join(w), "en", "a"))
            w = list(w)
            for _ in range(rng.choice((0, 1, 1, 2))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return rows


def test_edge_cases(spark, edge):
    assert result(edge) == brute(edge_rows())


def test_chains_match_brute_force(spark):
    rows = chains(1)
    assert result(make(spark, rows)) == brute(rows)


def test_small_blocks_change_nothing(spark):
    rows = chains(2, groups=6, copies=30)
    assert result(make(spark, rows), block_shingles=300) == brute(rows)


def test_one_id_with_unlike_texts(spark):
    rng = random.Random(4)
    a, b, c = (words(rng, 60, 10_000) for _ in range(3))
    rows = [(7, a, "en", "s"), (7, b, "en", "s"), (9, a, "en", "s"), (5, b + " more", "en", "s"), (8, c, "en", "s"), (8, c, "en", "s"), (8, None, "en", "s")]
    assert result(make(spark, rows)) == brute(rows)
    found = minhash.near_duplicates(make(spark, rows)).collect()
    groups = {(r["doc_id"], r["component_id"]): r["group_id"] for r in found}
    assert groups[7, 7] == groups[9, 7] and groups[7, 5] == groups[5, 5] != groups[7, 7]


def test_empty(empty):
    assert result(empty) == []


def thue_morse(bits=10):
    """Two texts of 2 ** bits letters that differ everywhere and that sums over powers modulo 2 ** 64 can't tell apart."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_regular_words_are_told_apart(spark):
    one, two = thue_morse()
    rows = [(1, one, "en", "a"), (2, two, "en", "a"), (3, f"a {one} b c {two} d e", "en", "a"), (4, f"a {two} b c {one} d e", "en", "a"), (5, one, "en", "b")]
    assert result(make(spark, rows)) == brute(rows) == [(1, 1, 1, True), (2, 1, 2, True), (3, 3, 3, True), (4, 3, 4, True), (5, 1, 1, False)]


def test_span_hashes_are_polynomials_modulo_the_prime(monkeypatch):
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(2000)), np.uint8)
    start = np.sort(np.array([rng.randrange(1900) for _ in range(200)]))
    end = np.sort(start + np.array([rng.randrange(1, 100) for _ in start]))
    end = np.maximum(end, start + 1)
    want = []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        h = sum((int(c) + 1) * pow(_text._BASE, i, _text._PRIME) for i, c in enumerate(data[a:b])) % _text._PRIME
        want.append(int(_text.mix(np.array([h], np.uint64))[0]))
    for piece in (64, 1 << 18):  # spans over many borders, and over none
        monkeypatch.setattr(_text, "_PIECE", piece)
        _text._powers.cache_clear()
        assert _text.span_hash(data, start, end).tolist() == want
    _text._powers.cache_clear()


def test_a_very_long_text_is_hashed_piece_by_piece(monkeypatch):
    rng = random.Random(3)
    text = words(rng, 4000, 900) + " " + "x" * 30_000 + " end"
    column = pa.array([text])
    want = _text.word_hashes(next(_text.chunks(column)))[0].tolist()
    cut = _text.pieces
    monkeypatch.setattr(_text, "pieces", lambda data: cut(data, 1000))
    got, bounds = _text.word_hashes(next(_text.chunks(column)))
    assert got.tolist() == want and bounds.tolist() == [0, len(want)] and len(want) == 4002

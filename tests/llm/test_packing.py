import itertools
import random
import zlib
from collections import Counter

import numpy as np

from panweave.llm import packing
from tests.llm.conftest import edge_rows, make


def test_encoder_is_the_tokenizer():
    fast = packing.Encoder(*packing.tokenizer_paths())
    slow = packing.Encoder(packing.tokenizer_paths()[0])
    rng = random.Random(1)
    odd = ["", " ", "  a  b\n\n c", "it's  we'll 12½ x²\t\t y", "naïve—café “q”", "emoji 😀 x", "<|endoftext|> hi", " \n \n\na", "日本語 text", "a b", "x" * 300]
    mixed = ["".join(rng.choice(["a", "é", " ", "\n", "'s", "'", "1", "½", "—", "\t", "|", "\r", "ll"]) for _ in range(60)) for _ in range(60)]
    wild = ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3100), rng.randrange(0xE000, 0x20000), 32, 39, 115, 10])) for _ in range(40)) for _ in range(300)]
    plain = ["".join(rng.choice("ab éß½² \t\n'sll.!0—") for _ in range(80)) for _ in range(300)]
    long = [" " * 300_000 + "a", "\n" * 300_000, "ab" * 200_000, "\t \n" * 100_000 + "x", "!?" * 100_000, "a" + "\n" * 1_500_000]
    for text in odd + mixed + wild + plain + long:
        assert fast(text) == slow(text), text[:100]


def test_fullest_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(1, 60)
        found = packing.fullest(room, counts)
        assert all(k <= counts[s] for s, k in found.items())
        best = max(t for ks in itertools.product(*[range(n + 1) for n in counts.values()]) if (t := sum(s * k for s, k in zip(counts, ks, strict=True))) <= room)
        assert sum(s * k for s, k in found.items()) == best


def test_plan_covers_the_histogram():
    rng = random.Random(3)
    counts = Counter(rng.randrange(1, 1025) for _ in range(5000))
    stretches, bins = packing.plan_bins(dict(counts))
    assert bins <= 1.02 * sum(s * n for s, n in counts.items()) / 1024 + 1
    few = {s: n for s, n in counts.items() if s <= 400}
    assert packing.plan_bins(few)[1] == -(-sum(s * n for s, n in few.items()) // 1024)
    assert packing.plan_bins({}) == ([], 0)


def test_every_bin_is_the_fullest_of_what_is_left():
    """Replays the bins in order: each takes the largest length left and, by brute force, the fullest rest."""
    rng = random.Random(8)
    for _ in range(30):
        counts = Counter(rng.randrange(1, 40) for _ in range(14))
        stretches, bins = packing.plan_bins(dict(counts), 40)
        held = {}
        for size, first, at, k, _ in stretches:
            later = [x for x in stretches if x[0] == size and x[1] > first]
            end = min((x[1] for x in later), default=counts[size])
            for rank in range(first, end):
                held.setdefault(at + (rank - first) // k, []).append(size)
        left = Counter(counts)
        for b in range(bins):
            top = max(s for s in left if left[s])
            assert top in held[b]
            left[top] -= 1
            sizes = sorted(left.elements())
            best = max(sum(c) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if sum(c) <= 40 - top)
            assert sum(held[b]) == top + best
            left[top] += 1
            left -= Counter(held[b])
        assert not +left


def test_equal_rows_are_dealt_over_the_cells(spark):
    rows = spark.range(20_000, numPartitions=4).selectExpr("id AS _row", "7L AS doc_id", "0 AS piece", "0L AS start", "3L AS length", "1L AS ids_crc32")
    cells = rows.selectExpr(f"pmod(xxhash64(_row), {packing.SALTS}) AS salt").groupBy("salt").count().toPandas()
    assert cells["count"].max() < 200
    got = packing.assign(packing.Tables(spark, "t"), packing.Tables(spark, "t").save(rows), 9).toPandas()
    assert got.groupby("sequence_id").size().max() == 3 and got["sequence_id"].nunique() == 6667 and not got.duplicated(["sequence_id", "offset"]).any()


def test_special_tokens_are_as_the_tokenizer_gives_them(spark):
    ids = np.array([64, 220, 50256, 275], "<u4").tobytes()
    assert packing.Encoder(*packing.tokenizer_paths())("a <|endoftext|> b") == ids
    r = packing.pack(make(spark, [(1, "a <|endoftext|> b", "en", "a")])).first()
    assert (r["length"], r["ids_crc32"]) == (5, zlib.crc32(ids + np.array([2], "<u4").tobytes()))


def check(rows, got, length=1024):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_paths()[0])
    whole = Counter((d, np.array([*slow.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t, *_ in rows)
    want = Counter()
    for (d, ids), n in whole.items():
        total, at, k = len(ids) // 4, 0, 0
        while at < total:
            step = total if total <= length else (total - at) % length or length
            want[d, k, at, step, zlib.crc32(ids[4 * at : 4 * (at + step)])] += n
            at, k = at + step, k + 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    tokens = sum(r["length"] for r in got)
    assert len(bins) <= tokens / length * 1.02 + 2


def test_edge_cases(spark, edge):
    check(edge_rows(), packing.pack(edge).collect())


def test_repeated_rows_and_short_sequences(spark):
    rows = [(i % 3, "some words to pack " * (i % 7), "en", "a") for i in range(80)]
    check(rows, packing.pack(make(spark, rows)).collect())


def test_ids_are_carried(spark, edge):
    for r in packing.pack(edge, with_ids=True).collect():
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]


def test_empty(empty):
    assert packing.pack(empty).collect() == []

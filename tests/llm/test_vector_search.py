"""Exact top-k search and hard-negative mining against plain Python on whole numbers."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panweave.llm import _vectors as V
from panweave.llm import negatives, topk

SCHEMA = "vec_id long, embedding array<double>, label long, seat string, id int, shard string, score string, rank int, norm string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "sh", "sc", 2, "n") for r in rows], SCHEMA)


def usable(rows):
    out = []
    for seat, (i, e, label) in enumerate(rows):
        if i is not None and e is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in e):
            out.append((seat, i, [math.floor(256 * x) for x in e], label))
    return out


def score(a, b):
    return max(V.LOW + 1, min(V.HIGH, sum(x * y for x, y in zip(a, b, strict=True))))


def plain_top(rows, k=5, every=50):
    rows, out = usable(rows), []
    for s, q, a, _ in rows:
        if q % every == 0:
            best = sorted(((-score(a, b), i) for t, i, b, _ in rows if t != s and len(a) == len(b)))[:k]
            out += [(q, r, i, -n) for r, (n, i) in enumerate(best, 1)]
    return Counter(out)


def plain_negatives(rows, every=50, p=5, k=3, low=50, high=95):
    rows, out = [r for r in usable(rows) if r[3] is not None], []
    for s, q, a, label in rows:
        if q % every:
            continue
        others = sorted((-score(a, b), i, t, la) for t, i, b, la in rows if t != s and len(a) == len(b))
        for n, pos, _, _ in [x for x in others if x[3] == label][:p]:
            fit = [(i, -m) for m, i, _, la in others if la != label and low * -n <= 100 * -m <= high * -n][:k]
            out += [(q, pos, r, i, -n, m) for r, (i, m) in enumerate(fit, 1)]
    return Counter(out)


def cloud(n, dim=8, seed=0, spread=True):
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, dim)) * (r.pareto(1.5, (n, 1)) + 0.1 if spread else 1)
    return [(i, v[i].tolist(), int(r.integers(4))) for i in range(n)]


HUGE = 2.0**40
EDGE = [(1000, None, 1), (1001, [1.0, None, 2.0], 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] * 8, 2), (None, [1.0] * 8, 1), (1050, [], 1), (1051, [], 2), (1052, [], 1),
        (1100, [1.0, 2.0], 1), (1101, [1.0, 2.5], 1), (1102, [1.0, 1.2], 2), (1103, [0.9, 1.0], 3), (1150, [HUGE] * 8, 1), (1151, [HUGE, -HUGE] * 4, 1), (1152, [HUGE * 0.7] * 8, 2), (1153, [HUGE + 1] * 8, 1), (1200, [1e200] * 8, 1),
        (1201, [1e200] * 8, 1), (1202, [1e308] * 8, 1), (1250, [0.5] * 8, None), (1300, [0.0] * 8, 1), (50, [0.25] * 8, 1), (50, [0.25] * 8, 1), (-100, [0.25] * 8, 2), (1350, [-0.001] * 8, 3)]
COPIES = [(2000 + i, [0.5, 0.25, -0.125, 1.0, 0.0, 0.75, 0.1, 0.2], i % 2) for i in range(120)]


@pytest.mark.parametrize("rows", [cloud(300) + EDGE, cloud(150, seed=1) + COPIES, COPIES[:3], []], ids=["edge", "copies", "few", "none"])
def test_top_k_is_brute_force(spark, rows):
    df = frame(spark, rows)
    got = topk.top_k(df)
    assert Counter(tuple(r) for r in got.collect()) == plain_top(rows)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_top_k_takes_groups_shards_and_other_queries(spark, monkeypatch):
    rows = cloud(260, 5, 2) + COPIES
    rows = [r for r in rows if len(r[1]) == 5] + [(i, e[:5], la) for i, e, la in COPIES]
    monkeypatch.setattr(V, "shard_count", lambda _: 7)
    got = topk.top_k(frame(spark, rows), every=3, k=4, group_rows=10)
    assert Counter(tuple(r) for r in got.collect()) == plain_top(rows, 4, 3)


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_pieces_of_a_tile(piece):
    r = np.random.default_rng(3)
    m = r.integers(-3, 4, (40, 4)).astype(float)
    rows = V.Rows(np.arange(40), r.permutation(40) // 2, np.full(40, ""), np.full(40, 4), np.sqrt((m * m).sum(1)), m, 0, None)
    owner, place, score_ = topk.tile_lists(rows, rows.take(slice(0, 9)), 5, piece)
    for q in range(9):
        want = sorted((-int(m[q] @ m[j]), int(rows.id[j]), j) for j in range(40) if j != q)[:5]
        got = [(-int(s), int(rows.id[j]), int(j)) for s, j in zip(score_[owner == q], place[owner == q], strict=True)]
        assert sorted(got) == want


def test_lists_merge_as_a_tree(spark):
    lists = [(a, p, 100 * p + j, j % 4, (7 * p + 3 * j) % 11) for a in (1, 2) for p in range(13) for j in range(3)]
    df = spark.createDataFrame(lists, "ask long, part int, seat long, id long, score long")
    got = {(r["ask"], r["rank"]): (r["score"], r["id"]) for r in V.merged(df, ["ask"], 4, 13, fan=3).collect()}
    for a in (1, 2):
        want = sorted((-s, i, t) for b, _, t, i, s in lists if b == a)[:4]
        assert [got[a, k + 1] for k in range(4)] == [(-s, i) for s, i, _ in want]


@pytest.mark.parametrize("rows", [cloud(300) + EDGE, cloud(150, seed=1) + COPIES, [(0, [1.0], 1)], []], ids=["edge", "copies", "one", "none"])
def test_negatives_are_brute_force(spark, rows):
    got = negatives.mine(frame(spark, rows), F.col("label"))
    assert Counter(tuple(r) for r in got.collect()) == plain_negatives(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_shelves_groups_and_limits_change_nothing_else(spark):
    rows = cloud(400, 6, 5)
    got = negatives.mine(frame(spark, rows), F.col("label"), every=20, positives=3, negatives=4, from_percent=30, to_percent=110, group_rows=16, shards=9)
    want = plain_negatives(rows, 20, 3, 4, 30, 110)
    assert Counter(tuple(r) for r in got.collect()) == want and sum(want.values()) > 50


def test_query_relabels(spark, tmp_path):
    rows = [(i, [math.sin(i * k) for k in range(1, 7)], i % 10) for i in range(200)] + [(350, [0.1] * 6, None)]
    frame(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = negatives.query(spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == plain_negatives([(i, e, (la + 1) % 10 if i % 7 == 0 and la is not None else la) for i, e, la in rows])


def test_norms_prune_buckets():
    """With long-tailed norms most buckets aren't multiplied; the lists are those of a visit that reads everything."""
    rows = usable(cloud(4000, 6, 8))
    m = np.array([e for _, _, e, _ in rows], float)
    shelf = V.Rows(np.arange(len(m)), np.array([i for _, i, _, _ in rows]), np.array([la for *_, la in rows], object), np.full(len(m), 6), np.sqrt((m * m).sum(1)), m, 0, None)
    asks = shelf.take(slice(0, 50))
    windows = (np.arange(50), np.full(50, V.LOW + 1), np.full(50, V.HIGH), np.full(50, V.LOW + 1))
    out = {bucket: negatives.visit(shelf, asks, windows, 5, True, bucket) for bucket in (64, 4000)}
    lists = [sorted(zip(w.tolist(), p.tolist(), s.tolist(), strict=True)) for w, p, s, _ in out.values()]
    assert lists[0] == lists[1] and out[64][3] < 0.6 * out[4000][3]

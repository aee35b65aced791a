import math

import numpy as np

from panweave.llm import embed


def brute(rows, kind=np.float32):
    ok = {}
    for i, (v, e, label) in enumerate(rows):
        if v is not None and e is not None and label is not None and all(x is not None and math.isfinite(x) for x in e) and any(e):
            ok[i] = np.array(e, kind).astype(float)
    near = {i: [] for i in ok}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / math.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= 0.98:
                near[i].append(j)
    out = []
    for i, (v, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = None if v is None else min(rows[j][0] for j in seen)
        out.append((v, len(near.get(i, [])), c, v is not None and v == c))
    return sorted(out, key=str)


def cloud(n, seed=0, dim=24):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        centre = r.standard_normal(dim)
        for k in range(r.integers(1, 5)):
            rows.append((len(rows), [float(x) for x in (centre + k * 0.05 * r.standard_normal(dim)).astype(np.float32)], str(i % 2)))
    return rows


EDGE = [(1100, None, "0"), (1101, [0.0, 0.0], "0"), (1102, [1.0, float("nan")], "0"), (1103, [1.0, None], "0"), (1104, [1.0, float("inf")], "0"), (1105, [1.0, 0.0], None), (1106, [1.0, 0.0], "0"), (1107, [1.0, -0.0], "0"), (1107, [1.0, 0.0], "0"),
        (1108, [2.0, 0.0], "0"), (1109, [1.0, 0.0], "1"), (None, [1.0, 0.0], "0"), (1110, [], "0"), (1111, [3e38, 1e30], "0"), (1112, [1.0, 0.0, 0.0], "0")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label string, rep string, n int")


def result(df, **options):
    return sorted([tuple(r) for r in embed.near_duplicates(df, **options).collect()], key=str)


def test_matches_brute_force(spark):
    rows = cloud(60) + EDGE
    assert result(frame(spark, rows)) == brute(rows)


def test_blocks_and_grid_change_nothing(spark):
    rows = cloud(40, 3)
    want = brute(rows)
    assert result(frame(spark, rows), block=8, dims=3) == want
    assert result(frame(spark, rows), block=1000, dims=1) == want


def test_double_vectors_are_compared_as_they_are(spark):
    """Pairs on both sides of the threshold that single precision can't tell apart, and components beyond its range."""
    rows = []
    for i, d in enumerate((-3e-9, -1e-12, 1e-12, 3e-9)):
        c = 0.98 + d
        rows.append((10 + i, [c * 1e60, math.sqrt(1 - c * c) * 1e60], str(i)))
        rows.append((20 + i, [1.0, 0.0], str(i)))
    rows += [(40, [1e-300, 2e-300], "9"), (41, [1.0, 2.0], "9"), (42, [1.0, 2.0 + 1e-9], "9"), (43, [3.0, 1.0], "9"), (43, [1.0, 3.0], "9"), (44, [1.0, 3.0001], "9")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    want = []
    near = lambda x, y: x[2] == y[2] and sum(a * b for a, b in zip(x[1], y[1], strict=True)) / math.hypot(*x[1]) / math.hypot(*y[1]) >= 0.98
    for i, x in enumerate(rows):
        links = [j for j, y in enumerate(rows) if j != i and near([x[0], [v / max(map(abs, x[1])) for v in x[1]], x[2]], [y[0], [v / max(map(abs, y[1])) for v in y[1]], y[2]])]
        least = min([x[0], *[rows[j][0] for j in links]])
        want.append((x[0], len(links), least, x[0] == least))
    assert result(df) == sorted(want, key=str)
    assert [r[1] for r in result(df) if 20 <= r[0] < 24] == [0, 0, 1, 1]


def test_empty(spark):
    assert result(frame(spark, [])) == []
    assert result(frame(spark, [(1, None, None)])) == [(1, 0, 1, True)]


def test_recall_at_the_threshold():
    """Pairs just above the threshold reach the count at the rate that the windows are calibrated for."""
    r = np.random.default_rng(1)
    w = embed.calibrate(embed.PROJECTIONS, embed.MISSES, embed.RECALL) * math.sqrt(2 - 2 * 0.98)
    hit = 0
    for _ in range(2000):
        u = r.standard_normal(64)
        u /= np.linalg.norm(u)
        v = r.standard_normal(64)
        v -= (v @ u) * u
        v = 0.98 * u + math.sqrt(1 - 0.98**2) * v / np.linalg.norm(v)
        p = r.standard_normal((64, embed.PROJECTIONS))
        hit += (np.abs(u @ p - v @ p) <= w).sum() >= embed.PROJECTIONS - embed.MISSES
    assert hit >= 1990

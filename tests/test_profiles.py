"""Packed profiles, and neighbour_correlation without a row for every pair and subject."""

import math

import numpy as np

from panweave.config import Config
from panweave.functions import profiles
from panweave.operators import homology


def test_packed_profiles_come_back():
    for s, v in (([5], [0]), ([-3, 0, 255], [1, -2, 3]), ([0, 256, 70_000, 1 << 40], [300, -300, 1, 2]), ([1, 1 << 62], [127, -128])):
        got = profiles.unpacked(profiles.packed(np.array(s, np.int64), np.array(v, np.int32)))
        assert got[0].tolist() == s and got[1].tolist() == v


def test_no_row_for_a_pair_and_subject(spark):
    n = 60
    rows = [(q, s, float(10 ** ((q * s) % 5) * 3)) for q in range(n) for s in range(n) if q != s and (q + s) % 3]
    h = spark.createDataFrame(rows, "q long, s long, bits double")
    pairs = h.selectExpr("least(q, s) a", "greatest(q, s) b").distinct()
    out = homology.neighbour_correlation(h, pairs, Config())
    got = {(r["a"], r["b"]): r["r"] for r in out.collect()}
    bits = {(q, s): b for q, s, b in rows}
    assert len(got) == pairs.count() > 1000
    for (a, b), r in got.items():
        subjects = sorted({s for q, s in bits if q in (a, b)})
        x, y = ([round(math.log10(bits.get((q, s), 28.0))) for s in subjects] for q in (a, b))
        assert abs(r - (float(np.corrcoef(x, y)[0, 1]) if len(set(x)) > 1 and len(set(y)) > 1 else 1.0)) < 1e-9
    # the joins of profiles are by sequence, none of them by sequence and subject
    assert "v1" not in out._jdf.queryExecution().toString() and "MapInArrow" in out._jdf.queryExecution().toString()

"""neighbour_correlation: profiles of all hits and all pairs of hits."""

import math

import numpy as np

from panweave.plans import registry


def test_weak_hits_count(spark, tmp_path):
    d, lines = str(tmp_path), [(1, 1, 50), (1, 2, 50), (1, 3, 1), (2, 1, 50), (2, 3, 30), (3, 2, 2), (3, 4, 50), (4, 3, 9), (4, 4, 9), (5, 1, 3), (5, 4, 20)]
    spark.createDataFrame([(o, p, float(n)) for o, p, n in lines], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(p, f"B{p}") for p in (1, 2, 3, 4)], "p_partkey long, p_brand string").write.parquet(f"{d}/part.parquet")
    bits = {}
    for o, p, n in lines:
        for o2, p2, n2 in lines:
            if o == o2 and p != p2:
                bits[p, p2] = bits.get((p, p2), 0) + n * n2
    want = {}
    for a, b in bits:
        if a < b:
            subjects = {s for q, s in bits if q in (a, b)}
            x, y = ([round(math.log10(bits.get((q, s), 28))) for s in subjects] for q in (a, b))
            want[a, b] = round(float(np.corrcoef(x, y)[0, 1]), 6) if len(set(x)) > 1 and len(set(y)) > 1 else 1.0
    got = {(r["a"], r["b"]): round(r["r"], 6) for r in registry.QUERIES["neighbour_correlation"](spark, d).collect()}
    assert got == want and len(want) == 6

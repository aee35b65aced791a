"""neighbour_correlation in blocks: a profile travels to groups of sequences, not to each of its pairs."""

import math
import random

import numpy as np
import pytest

from panweave.config import Config
from panweave.operators import homology


@pytest.mark.parametrize("far", [1, 1 << 18, 1 << 33])
def test_blocks_of_any_size_give_the_same(spark, far):
    rng = random.Random(far)
    rows = {(q, s * far - 7): float(rng.choice((1, 30, 3000, 400_000))) for q in range(40) for s in rng.sample(range(90), 60 if q == 3 else rng.randrange(1, 9))}
    h = spark.createDataFrame([(q, s, b) for (q, s), b in rows.items()], "q long, s long, bits double")
    asked = [(rng.randrange(44), rng.randrange(44)) for _ in range(300)] + [(3, k) for k in range(44)] * 2
    pairs = spark.createDataFrame(asked, "a long, b long")
    profile = {q: {s: round(math.log10(b)) for (p, s), b in rows.items() if p == q} for q in range(44)}
    want = {}
    for a, b in set(asked):
        every = sorted(profile[a].keys() | profile[b].keys())
        x, y = ([p.get(s, 1) for s in every] for p in (profile[a], profile[b]))
        if every:
            want[a, b] = float(np.corrcoef(x, y)[0, 1]) if len(set(x)) > 1 and len(set(y)) > 1 else 1.0
    for size in (20, homology.BLOCK_HITS):
        out = homology.neighbour_correlation(h, pairs, Config(), block_hits=size)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) and all(abs(want[a, b] - r) < 1e-9 for a, b, r in got)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Repartition") == 1
    own = {(min(q, s), max(q, s)) for q, s in rows}
    assert {(r["a"], r["b"]) for r in homology.neighbour_correlation(h, None, Config()).collect()} == own

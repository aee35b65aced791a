"""Bins of hits: places are counted as rows are written, and no task sends more of a bin than the bin keeps."""

import random

from panweave.operators import ranks, stats
from panweave.tables import Tables


def test_places_and_tops_of_bins(spark):
    rng = random.Random(3)
    rows = [(q, s, float(rng.randrange(50)), float(rng.randrange(8))) for q in range(40) for s in range(60)]
    df = spark.createDataFrame(rows, "q long, s long, bits double, lp double")
    placed = ranks.ranked(Tables(spark, "p"), df, [], ["lp", "q", "s"], "place")
    order = sorted(rows, key=lambda r: (r[3], r[0], r[1]))
    assert [tuple(r)[:4] for r in sorted(placed.collect(), key=lambda r: r["place"])] == order and placed.agg({"place": "max"}).first()[0] == len(rows)
    assert "row_number" not in placed._jdf.queryExecution().toString()
    for size, percent in ((1000, 5), (7, 50), (5000, 1), (3, 10)):
        bins = [order[i : i + size] for i in range(0, len(order), size)]
        want = sorted(x for b in bins for x in sorted(b, key=lambda r: (-r[2], r[0], r[1]))[: max(int(len(b) * percent // 100), 1)])
        top = stats.score_bins(df, size, percent)
        assert sorted((r["q"], r["s"], r["bits"], r["lp"]) for r in top.collect()) == want
        assert "WindowGroupLimit" in top._jdf.queryExecution().toString() or size == 5000

"""contained() against all pairs, for sequences of every length."""

import random

from panweave.operators import sequences


def test_short_sequences(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACé") for _ in range(n)) for n in range(1, 60, 2)]
    texts += [t[i : i + n] for t in texts[10:] for i, n in ((0, 4), (2, 11), (1, 15))] + ["A" * 22, "A" * 23, "A" * 24, "A" * 24, "zz", "", "short"]
    rows = list(enumerate(texts)) + [(900, None)]
    want = {}
    for i, s in rows[:-1]:
        inside = [j for j, t in rows[:-1] if len(t) > len(s) and s in t]
        if inside:
            want[i] = min(inside)
    out = sequences.contained(spark.createDataFrame(rows, "seq_id long, seq string")).collect()
    assert {r["seq_id"]: r["container"] for r in out} == want and len(out) == len(want)


def test_long_and_common_sequences(spark):
    """Texts on both sides of the schemes' border, copies, and a passage that all texts begin with."""
    rng = random.Random(6)
    head = "".join(rng.choice("ACGT") for _ in range(300))
    bodies = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (10, 200, 400, 900)]
    texts = [head + b for b in bodies for _ in range(2)] + [head, head[:255], head[:254], head[20:290], bodies[3][5:800], bodies[2][:23], bodies[2][:22], bodies[1][3:]]
    rows = list(enumerate(texts)) + [(3, texts[1])]
    want = set()
    for i, s in rows:
        inside = [j for j, t in rows if len(t) > len(s) and s in t]
        if inside:
            want.add((i, min(inside)))
    out = [tuple(r) for r in sequences.contained(spark.createDataFrame(rows, "seq_id long, seq string")).collect()]
    assert set(out) == want

"""Clusters carried from arrival to arrival equal those of one run over all hits so far."""

import random

from panweave.config import HITS, Config
from panweave.streaming import incremental

CFG = Config(evalue=0.5, identity=50, coverage=40)


def _plain(rows):
    """(node, component) from all hits by the definition."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and r[3] is not None and r[2] != r[3] and r[4] is not None and r[4] >= 0]
    low = {}
    for r in rows:
        low[r[0], r[3]] = min(r[4], low.get((r[0], r[3]), 9e9))
    ties = {(r[0], r[1]) for r in rows if r[4] == low[r[0], r[3]] and r[4] <= 0.5 and r[5] is not None and r[5] >= 50 and min(r[6], r[7]) >= 40}
    links = {(a, b) for a, b in ties if (b, a) in ties}
    root = {a: a for pair in links for a in pair}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                moved = True
    return root


def _hits(rng, n, best):
    taxon = lambda x: f"T{x % 4}"
    out = []
    for _ in range(n):
        a, b = rng.randrange(40), rng.randrange(40)
        e = rng.choice([0.0, 0.01, 0.1, 0.2, 0.3]) if best else rng.choice([0.2, 0.3, 0.4])
        for q, s in ((a, b), (b, a))[: rng.choice([1, 2, 2, 2])]:
            out.append((q, s, taxon(q), taxon(s), e, rng.choice([40.0, 90.0, 90.0, 90.0]), 80.0, rng.choice([30.0, 80.0, 80.0]), 50.0, 1))
    return out


def test_arrivals_equal_one_run(spark, tmp_path):
    rng = random.Random(11)
    parts = [_hits(rng, 40, False), _hits(rng, 30, True), [], _hits(rng, 60, True), _hits(rng, 20, False)]
    parts[1] += parts[0][:5] + [(None, 1, "T1", "T2", 0.1, 90.0, 80.0, 80.0, 50.0, 1), (1, 2, "T1", "T2", float("nan"), 90.0, 80.0, 80.0, 50.0, 1),
                                (3, 2, None, "T2", 0.1, 90.0, 80.0, 80.0, 50.0, 1), (5, 6, "T1", "T2", None, None, 80.0, 80.0, 50.0, 1)]
    source, target, progress = (f"file://{tmp_path}/{n}" for n in ("in", "state", "progress"))
    so_far, split = [], 0
    for part in parts:
        spark.createDataFrame(part, HITS).coalesce(1).write.mode("append").parquet(source)
        incremental.follow_clusters(spark, source, target, progress, CFG, whole_every=3).awaitTermination()
        before = _plain(so_far)
        so_far += part
        want = _plain(so_far)
        split += any(want.get(n) != c and n in before for n, c in before.items())
        got = incremental.current_clusters(spark, target).collect()
        assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert split  # better hits took links away, too


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rng = random.Random(12)
    parts = [_hits(rng, 40, False), _hits(rng, 40, True)]
    state = incremental.ClusterState(spark, f"file://{tmp_path}/state")
    state.create()
    for k, part in enumerate(parts):
        for _ in range(2):
            incremental.update_clusters(state, spark.createDataFrame(part, HITS), k, CFG)
    got = {r["node"]: r["component"] for r in state.members().collect()}
    assert got == _plain(parts[0] + parts[1])


def test_only_touched_components_are_written(spark, tmp_path):
    row = lambda q, s, e: (q, s, f"T{q % 2}", f"T{s % 2}", e, 90.0, 80.0, 80.0, 50.0, 1)
    both = lambda q, s, e: [row(q, s, e), row(s, q, e)]
    state = incremental.ClusterState(spark, f"file://{tmp_path}/state")
    state.create()
    incremental.update_clusters(state, spark.createDataFrame(both(2, 3, 0.2) + both(4, 5, 0.2), HITS), 0, CFG)
    incremental.update_clusters(state, spark.createDataFrame(both(4, 7, 0.1), HITS), 1, CFG)
    written = spark.read.parquet(f"{state.target}/members/whole=0/batch=1").collect()
    assert {r["node"]: r["component"] for r in written} == {4: 4, 5: None, 7: 4}
    assert {r["node"]: r["component"] for r in state.members().collect()} == {2: 2, 3: 2, 4: 4, 7: 4}

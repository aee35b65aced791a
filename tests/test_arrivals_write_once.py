"""An arrival writes the ties that it adds once, and no other table of hits."""

from panweave.config import HITS, Config
from panweave.streaming import incremental
from panweave.tables import Tables

CFG = Config(evalue=0.5, identity=50, coverage=40)


def test_no_table_of_hits_beside_the_state(spark, tmp_path, monkeypatch):
    saved = []

    class Counted(Tables):
        def save(self, df):
            saved.append(df.columns)
            return super().save(df)

    monkeypatch.setattr(incremental, "Tables", Counted)
    row = lambda q, s, e: (q, s, f"T{q % 2}", f"T{s % 2}", e, 90.0, 80.0, 80.0, 50.0, 1)
    both = lambda q, s, e: [row(q, s, e), row(s, q, e)]
    state = incremental.ClusterState(spark, f"file://{tmp_path}/state")
    state.create()
    for k, part in enumerate((both(2, 3, 0.2) + both(4, 5, 0.2), both(4, 7, 0.1) + both(2, 3, 0.2), both(4, 5, 0.3) + both(2, 5, 0.1)[:1])):
        incremental.update_clusters(state, spark.createDataFrame(part, HITS), k, CFG)
    assert saved and not [c for c in saved if "evalue" in c]
    ties = [tuple(r) for r in state.ties().select("q", "s", "evalue").collect()]
    assert sorted(ties) == [(2, 3, 0.2), (2, 5, 0.1), (3, 2, 0.2), (4, 5, 0.2), (4, 7, 0.1), (5, 4, 0.2), (7, 4, 0.1)]
    assert {r["node"]: r["component"] for r in state.members().collect()} == {4: 4, 7: 4}

"""Keys of cluster sets: a key that all clusters of a dir have is counted, not gathered in one window."""

from panweave.operators import clusters as C
from panweave.plans import views as V


def test_repeated_keys_are_counted_in_parts(spark):
    sets = spark.range(6000).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS dir", "id AS cluster_id", "CASE WHEN id < 5 THEN concat('m', id) ELSE 'common' END AS member")
    keys = C.keyed(sets, sets["member"])
    assert "Window" not in keys._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["dir"], r["cluster_id"], r["size"]) for r in keys.collect()) == [("a", 0, 1), ("a", 2, 1), ("a", 4, 1), ("b", 1, 1), ("b", 3, 1)]


def test_order_sets_keep_what_they_hold(spark, tmp_path):
    spark.createDataFrame([(1, "F"), (2, "O"), (2, "O")], "o_orderkey long, o_orderstatus string").write.parquet(f"file://{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 21), (1, 1), (1, 5), (1, None), (2, 40), (3, 1)], "l_orderkey long, l_partkey long").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    rows = V.order_sets(spark, f"file://{tmp_path}").collect()
    assert sorted((r["dir"], r["cluster_id"], r["member"] or "") for r in rows) == [("F", 1, ""), ("F", 1, "m1"), ("F", 1, "m5"), ("O", 2, "m0")]

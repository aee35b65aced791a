"""Plans over pairs take all reciprocal best hits, also those of few bits."""

from panweave.plans import registry


def values(df):
    return sorted(map(tuple, df.collect()))


def test_weak_pairs_are_links(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(k, p, 20.0) for k in (1, 2) for p in (1, 2, 3)] + [(3, 4, 20.0)], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(p, f"B{p}") for p in (1, 2, 3, 4)], "p_partkey long, p_brand string").write.parquet(f"{d}/part.parquet")
    q = registry.QUERIES
    assert values(q["cluster_components"](spark, d)) == [(1, 1), (2, 1), (3, 1)]
    assert values(q["sbh_triangles"](spark, d)) == [(1, 2, 3)]
    assert values(q["triangle_clusters"](spark, d)) == [(1, 1), (1, 2), (1, 3)]
    assert values(q["mcl_clusters"](spark, d).select("node")) == [(1,), (2,), (3,)]
    assert values(q["unmatched_singletons"](spark, d)) == [(4, "B4")]

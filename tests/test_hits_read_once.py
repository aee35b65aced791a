"""Hits are moved by their query once, and whole analyses read them once."""

import random

from panweave.config import Config
from panweave.operators import homology as H
from panweave.plans import views as V
from panweave.tables import Tables

D = "/root/testdata/sf0.001"


def test_pairs_are_dealt_by_their_query_once(spark):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ties = H.top_ties(V.hits(spark, D))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert ties.count("Exchange hashpartitioning(q#") == 2  # the pairs and the parts' brands; sums, ranks and ties were two or three more
    assert ties.count("Exchange hashpartitioning(s#") == 0


def test_ties_and_prefix_of_one_reading(spark):
    rng = random.Random(5)
    rows = [(q, s, f"t{q % 3}", f"t{s % 3}", rng.choice([1e-9, 1e-7, 1e-3, 1.0]), rng.choice([20.0, 90.0]), rng.choice([30.0, 80.0]), 80.0, 1.0) for q in range(40) for s in range(40) if rng.random() < 0.4]
    hits = H.ranked(spark.createDataFrame(rows, "q long, s long, tq string, ts string, evalue double, pident double, qcov double, scov double, bits double"))
    cfg = Config(evalue=0.01, identity=60, coverage=45)
    own, prefix = H.ties_and_prefix(Tables(spark, "test"), hits, cfg)
    want_own, want_prefix = H.top_ties(hits), H.prefix_before_foreign(hits, cfg)
    assert sorted(own.collect()) == sorted(want_own.select(own.columns).collect()) and own.count() > 50
    assert sorted(prefix.collect()) == sorted(want_prefix.select(prefix.columns).collect()) and prefix.count() > 3


def test_stored_hits_are_written_where_they_are(spark, tmp_path):
    from panweave.sources import text

    hits = spark.range(400, numPartitions=4).selectExpr("id AS q", "id + 1 AS s", "'one' AS tq", "'two' AS ts")
    text.store_hits(hits, f"file://{tmp_path}/h")
    assert len(list((tmp_path / "h" / "tq=one").glob("*.parquet"))) == 4  # a taxon was one task's
    assert text.stored_hits(spark, f"file://{tmp_path}/h", ["one"]).count() == 400

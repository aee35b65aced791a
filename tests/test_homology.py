"""Hits, graphs, clusters, folds: hand-made rows."""

import math

import pytest

from panweave.config import Config
from panweave.operators import clusters, graph, homology, intervals
from panweave.tables import Tables

CFG = Config()


def hits(spark, rows):
    """(q, s, tq, ts, evalue) with full identity and coverage."""
    df = spark.createDataFrame([(*r, 100.0, 100.0, 100.0, 50.0) for r in rows], "q long, s long, tq string, ts string, evalue double, pident double, qcov double, scov double, bits double")
    return homology.ranked(df)


def values(df):
    return sorted(map(tuple, df.collect()))


def test_best_hits_keep_ties(spark):
    h = hits(spark, [(1, 10, "A", "B", 1e-50), (1, 11, "A", "B", 1e-50), (1, 12, "A", "B", 1e-20), (1, 20, "A", "C", 1e-60)])
    assert values(homology.top_ties(h).select("q", "s")) == [(1, 10), (1, 11), (1, 20)]


def test_reciprocal_weight(spark):
    h = hits(spark, [(1, 2, "A", "B", 1e-10), (2, 1, "B", "A", 0.0), (1, 3, "A", "C", 1e-9)])
    ((a, b, _, _, w),) = values(homology.reciprocal(h, CFG))
    assert (a, b) == (1, 2) and w == pytest.approx(163.0)


def test_inparalog_prefix(spark):
    h = hits(spark, [(1, 1, "A", "A", 0.0), (1, 2, "A", "A", 1e-60), (1, 3, "A", "A", 1e-50), (1, 9, "A", "B", 1e-40), (1, 4, "A", "A", 1e-30)])
    assert values(homology.prefix_before_foreign(h, CFG).select("s")) == [(2,), (3,)]


def test_seeds_are_one_hop(spark):
    p = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert values(homology.seeds(p)) == [(2, 1), (3, 2)]


def test_rescue_and_domains(spark):
    df = spark.createDataFrame([(1, 2, "A", "B", 1e-10, 90.0, 50.0, 90.0, 9.0), (2, 1, "B", "A", 1e-10, 90.0, 90.0, 90.0, 9.0)], "q long, s long, tq string, ts string, evalue double, pident double, qcov double, scov double, bits double")
    h = homology.ranked(df)
    assert homology.reciprocal(homology.best(h, CFG), CFG).count() == 0
    assert homology.reciprocal(homology.best(h, CFG, rescue=True), CFG).count() == 1
    dom = spark.createDataFrame([(1, "PF1,")], "seq_id long, domains string")
    assert homology.best(h, CFG, domains=dom, rescue=True).count() == 0


def test_bdbh_clusters(spark):
    rows = [(1, 10, "A", "B", 1e-50), (10, 1, "B", "A", 1e-50), (1, 2, "A", "A", 1e-90), (2, 1, "A", "A", 1e-90), (1, 20, "A", "C", 1e-40), (20, 1, "C", "A", 1e-40), (10, 20, "B", "C", 1e-30), (20, 10, "C", "B", 1e-30)]
    taxa = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (10, "B"), (20, "C")], "seq_id long, taxon string")
    assert values(homology.bdbh_clusters(hits(spark, rows), taxa, "A", CFG)) == [(1, 1, "A"), (1, 2, "A"), (1, 10, "B"), (1, 20, "C")]


def test_neighbour_correlation(spark):
    h = spark.createDataFrame([(1, 5, 100.0), (1, 6, 1000.0), (2, 5, 100.0), (2, 6, 1000.0), (3, 5, 1000.0)], "q long, s long, bits double")
    p = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    r = {(x["a"], x["b"]): x["r"] for x in homology.neighbour_correlation(h, p, CFG).collect()}
    assert r[1, 2] == pytest.approx(1.0) and r[1, 3] < 0


def test_graphs(spark):
    t = Tables(spark, "t")
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {(r["node"], r["component"]) for r in graph.components(t, links).collect()} == {(i, 1) for i in range(1, 61)} | {(100, 100), (101, 100)}
    assert graph.components(t, links.filter("a < 0")).count() == 0
    w = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 1.0), (3, 4, 0.05)], "a long, b long, w double")
    assert {r["node"]: r["cluster"] for r in graph.mcl(t, w).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    e = spark.createDataFrame([(1, 2, "A", "B"), (2, 3, "B", "C"), (1, 3, "A", "C"), (2, 4, "B", "D"), (3, 4, "C", "D"), (4, 5, "D", "A")], "a long, b long, ta string, tb string")
    assert values(graph.triangles(e)) == [(1, 2, 3), (2, 3, 4)]
    got = graph.triangle_clusters(t, e)
    taxa = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D"), (5, "A")], "seq_id long, taxon string")
    assert got.select("cluster_id").distinct().count() == 1 and values(got.select("seq_id")) == [(1,), (2,), (3,), (4,)]
    assert values(graph.allot(got, taxa)) == [(1, 1), (1, 2), (1, 3), (1, 4)]
    two = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "cluster_id long, seq_id long")
    assert values(graph.allot(two, taxa)) == [(1, 1), (3, 3)]


def test_absorption(spark):
    p = spark.createDataFrame([("t", 1, 2), ("t", 2, 3), ("t", 1, 4)], "taxon string, q long, s long")
    assert values(graph.greedy_absorb(p, "taxon")) == [(2, 1), (4, 1)]
    roots, direct = graph.absorb_clusters(Tables(spark, "a"), spark.createDataFrame([("a", "b"), ("b", "c")], "keep string, gone string"))
    assert values(roots) == [("b", "a"), ("c", "a")] and values(direct.select("gone", "keep")) == [("b", "a"), ("c", "b")]


def test_cluster_sets(spark):
    c = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 3, "A"), (2, 4, "A"), (3, 5, "B")], "cluster_id long, seq_id long, taxon string")
    ids = lambda df: sorted({r["cluster_id"] for r in df.collect()})
    assert ids(clusters.min_taxa(c, 2)) == [1] and ids(clusters.min_taxa(c, 0)) == [1, 2, 3]
    assert ids(clusters.without_inparalogs(c)) == [1, 3] and ids(clusters.single_copy(c, 2)) == [1]
    s = spark.createDataFrame([("d1", 1, "ABCDEFGHI"), ("d2", 9, "XXXDEFYYY"), ("d1", 2, "QQQ"), ("d1", 3, "RRR")], "dir string, cluster_id long, member string")
    keys = clusters.keyed(s, s["member"], trim=3)
    assert keys.count() == 2  # the two that are equal within d1 go
    assert clusters.intersection(keys, 2).count() == 1
    assert values(clusters.sectors(keys, ["d1", "d2"])) == [(3, 1)]
    seqs = spark.createDataFrame([(1, "A"), (9, "C")], "seq_id long, taxon string")
    assert values(clusters.singletons(seqs, c)) == [(9, "C")]
    ref = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3)], "ref_id long, seq_id long")
    assert values(clusters.contained_in_one(ref, c)) == [(1, 1)]
    ln = spark.createDataFrame([(1, 1, 100), (1, 2, 90), (1, 3, 50)], "cluster_id long, place long, length long")
    assert values(clusters.similar_length(ln, 80, 2)) == [(1, 1, 100), (1, 2, 90)]


def test_synteny(spark):
    c = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 3, "A"), (2, 4, "B"), (3, 5, "A"), (3, 6, "B")], "cluster_id long, seq_id long, taxon string")
    n = spark.createDataFrame([(1, 3), (3, 1), (2, 4), (4, 2), (5, 1)], "seq_id long, neighbour long")
    assert values(clusters.syntenic(c, n)) == [(1,), (2,)]


def test_fold(spark):
    h = spark.createDataFrame([(1, 2, 90.0, 100, 200, 200, 1, 100, 1, 100, 1e-30, 100.0), (1, 2, 70.0, 21, 200, 200, 40, 60, 150, 170, 1e-20, 40.0), (1, 2, 80.0, 60, 200, 200, 121, 180, 121, 180, 1e-9, 50.0)], "q long, s long, pident double, alen int, qlen int, slen int, qs int, qe int, ss int, se int, evalue double, bits double")
    (r,) = intervals.fold_hsps(h).collect()
    assert (r["evalue"], r["pident"], r["qcov"], r["scov"], r["simspan"], r["bits"]) == (1e-30, 85.0, 80.0, 80.0, "1:1-100:1-100.2:121-180:121-180.", 150.0)
    (p,) = intervals.fold_hsps(h).select(intervals.parse_simspan(intervals.F.col("simspan")).alias("x")).collect()
    assert [tuple(x) for x in p["x"]] == [(1, 1, 100, 1, 100), (2, 121, 180, 121, 180)]


def test_domains_and_union(spark):
    d = spark.createDataFrame([(1, "PF1", "one", 1e-9, 1, 50), (1, "PF2", "two", 1e-5, 20, 40), (1, "PF3", "three", 1e-3, 60, 90)], "seq_id long, name string, descr string, evalue double, start int, end int")
    assert values(intervals.choose_domains(d)) == [(1, ["PF1", "PF3"], ["one", "three"])]
    iv = spark.createDataFrame([("a", 1, 10), ("a", 5, 12), ("a", 20, 20), ("a", 6, 7)], "k string, start long, end long")
    assert values(intervals.union_length(iv, "k")) == [("a", 13)]


def test_isoforms(spark):
    rows = [(1, 2, "A", "A", 100.0, 1, 60, 41, 100, 60, 100, 1), (1, 3, "A", "A", 99.0, 1, 60, 1, 60, 60, 60, 1), (1, 4, "A", "A", 100.0, 1, 30, 1, 30, 60, 60, 1)]
    df = spark.createDataFrame(rows, "q long, s long, tq string, ts string, pident double, qs int, qe int, ss int, se int, qlen int, slen int, n_segments int")
    assert values(homology.isoform_pairs(df, CFG).select("q", "s")) == [(1, 2)]
    assert math.isclose(Config.transcripts().identity, 95.0)

from panweave.config import Config
from panweave.functions import transcripts
from panweave.operators import homology, intervals, search
from panweave.plans import pipelines
from panweave.tables import Tables


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_search_to_clusters(spark):
    fam = {"f": "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVVHSLAKWKRQ", "g": "GSHMASMTGGQQMGRDLYDDDDKDPMLKRWWWCCNPPEHHTTYVVLIFGARRKDEQNNSSTGHWYCMPLIVAA"}
    rows = [(i + 10 * k, f"T{i}", s[i % 3 :]) for k, s in enumerate(fam.values()) for i in range(5)] + [(99, "T0", "QQQQQWERTNMCVHGGGPPPP")]
    seqs = spark.createDataFrame(rows, "seq_id long, taxon string, seq string")
    hsps = search.search(seqs)
    names = seqs.select("seq_id", "taxon")
    hits = intervals.fold_hsps(hsps).join(names.selectExpr("seq_id AS q", "taxon AS tq"), "q").join(names.selectExpr("seq_id AS s", "taxon AS ts"), "s")
    hits = Tables(spark, "hits").save(homology.ranked(hits.selectExpr("q", "s", "tq", "ts", "evalue", "pident", "qcov", "scov", "bits")))
    want = [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]]
    for algorithm in ("bdbh", "omcl", "cog"):
        found = {}
        for c, s, _ in map(tuple, pipelines.cluster(spark, hits, seqs, Config(), algorithm, "T1").collect()):
            found.setdefault(c, []).append(s)
        assert sorted(map(sorted, found.values())) == want, algorithm
    out = pipelines.run(spark, hits, seqs, Config())
    assert {r["compartment"] for r in out.compartments.collect()} <= {"cloud", "shell", "softcore"}
    assert out.clusters.select("cluster_id").distinct().count() == 3 and out.identity.count() == 25
    g = pipelines.simulate_growth(spark, out.pangenome, Config(growth_samples=3), 1)
    assert all(r["core"] <= r["soft"] <= r["pan"] for r in g.collect())


def test_pairs_in_order(spark):
    p = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "b", "c"), (4, "e", "a"), (5, "x", "y")], "ord int, a string, b string")
    assert values(pipelines.pairs_to_clusters(Tables(spark, "p"), p)) == [("a", "a"), ("a", "b"), ("a", "e"), ("c", "c"), ("c", "d"), ("x", "x"), ("x", "y")]


def test_compare(spark):
    s = spark.createDataFrame([("d1", 1, "ABCDEFGHI"), ("d2", 9, "XXXDEFYYY"), ("d2", 8, "KKKKKKKKK")], "dir string, cluster_id long, member string")
    both, sectors = pipelines.compare(s, ["d1", "d2"])
    assert both.count() == 1 and values(sectors) == [(2, 1), (3, 1)]


def test_frames():
    found = transcripts.open_frames("TAAATGAAACCCGGGTAATT", 4)
    assert (1, 4, 18, "complete", "MKPG") in found and found[0] == (1, 3, 20, "internal", "NETRVI")
    assert (1, 3, 20, "5prime", "TMKPG") in transcripts.open_frames("TAACCATGAAACCCGGGTAATT", 4)
    assert transcripts.longest_common("xxabcyy", "zabcz") == (3, 2, 1)
    assert transcripts.consensus("ABCDEF", "DEFGHI", 3) == "ABCDEFGHI" and transcripts.consensus("ABC", "XABCX", 3) == "XABCX" and transcripts.consensus("ABC", "XYZ", 3) == "ABC"

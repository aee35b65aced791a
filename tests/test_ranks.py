"""Ranks and lanes without a task that holds a group; consensus of coding sequences."""

import random

import pytest
from pyspark.sql import functions as F

from panweave.functions import transcripts
from panweave.operators import ranks, sequences, stats
from panweave.tables import Tables


def test_ranks_of_a_hot_group(spark):
    """A third of all rows in one group and of equal values, null groups, ties told apart by an id."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([1, 1, 1, 2, 3]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    got = {r["id"]: r["rank"] for r in ranks.ranked(Tables(spark, "r"), df, ["g"], [F.col("v").desc(), "id"]).collect()}
    for g in ("hot", "a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[i] for *_, i in own] == list(range(1, len(own) + 1))
    whole = {r["id"]: r["n"] for r in ranks.ranked(Tables(spark, "r"), df, [], ["v", "id"], "n").collect()}
    assert [whole[i] for _, _, i in sorted(rows, key=lambda r: (r[1], r[2]))] == list(range(1, 901))
    assert ranks.ranked(Tables(spark, "r"), df.limit(0), ["g"], ["id"]).count() == 0


def test_lanes(spark):
    """No two spans of a lane touch, as few lanes as spans over one place; alike spans, points and one long contig."""
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"c{i % 9}", a, a + rng.choice([0, 3, 10, 60]), i // 2) for i, a in enumerate(rng.randrange(300) for _ in range(600))]
    df = spark.createDataFrame(rows, "contig string, start long, end long, id long")
    got = ranks.lanes(Tables(spark, "l"), df, ["contig"], "start", "end", "id").collect()
    assert sorted((r["contig"], r["start"], r["end"], r["id"]) for r in got) == sorted(rows)
    for contig in {r[0] for r in rows}:
        own = [r for r in got if r["contig"] == contig]
        for lane in {r["lane"] for r in own}:
            spans = sorted((r["start"], r["end"]) for r in own if r["lane"] == lane)
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
        most = max(sum(s["start"] <= p <= s["end"] for s in own) for p in {r["start"] for r in own})
        assert {r["lane"] for r in own} == set(range(most))
    assert ranks.lanes(Tables(spark, "l"), df.limit(0), ["contig"], "start", "end", "id").count() == 0


def test_genome_map(spark):
    genes = spark.createDataFrame([(1, "R", "x", 1, 50, 1), (2, "R", "x", 40, 90, -1), (3, "R", "x", 91, 99, 1), (4, "S", "x", 1, 9, 1), (5, "R", "y", 5, 9, 1), (6, "R", "y", 5, 9, 1)], "seq_id long, taxon string, contig string, start long, end long, strand long")
    clusters = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("a", 4), ("c", 5)], "cluster string, seq_id long")
    parts = spark.createDataFrame([("a", "core"), ("b", "cloud")], "cluster string, compartment string")
    got = sorted(map(tuple, ranks.genome_map(Tables(spark, "g"), genes, clusters, parts, "R").collect()))
    assert got == [("x", "a", 1, 1, 50, 1, "core", 0), ("x", "a", 3, 91, 99, 1, "core", 0), ("x", "b", 2, 40, 90, -1, "cloud", 1), ("y", "c", 5, 5, 9, 1, None, 0)]


def test_bins_of_equal_products(spark):
    """20,000 hits of one length product: the bins are those of one sorted list."""
    rows = [(i, i % 7, float((i * 7919) % 10_007), 5000.0) for i in range(20_000)]
    df = spark.createDataFrame(rows, "q long, s long, bits double, lp double")
    got = stats.score_bins(df, 1000, 5).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("bits").alias("least")).collect()
    order = sorted(rows, key=lambda r: (r[3], r[0], r[1]))
    want = {k: sorted((r[2] for r in order[1000 * k : 1000 * k + 1000]), reverse=True)[:50] for k in range(20)}
    assert {r["bin"]: (r["n"], r["least"]) for r in got} == {k: (50, v[-1]) for k, v in want.items()}


def test_numbers_follow_the_files(spark):
    df = spark.createDataFrame([("b", 1, 5), ("b", 1, 2), ("a", 2, 1), ("a", 2, 9), ("c", 3, 0)], "file string, ord long, pos long")
    got = sorted((r["seq_id"], r["file"], r["pos"]) for r in sequences.number(df, ["pos"]).collect())
    assert got == [(1, "b", 2), (2, "b", 5), (3, "a", 1), (4, "a", 9), (5, "c", 0)]


def plain_common(a, b):
    best = (0, 0, 0)
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y or x == "*" or y == "N":
                new[j] = row[j - 1] + 1
                if new[j] > best[0]:
                    best = new[j], i - new[j], j - new[j]
        row = new
    return best


@pytest.mark.parametrize("letters", ["ACGT", "AC", "A", "ACGTN"])
def test_longest_common_substrings(letters):
    rng = random.Random(letters)
    for _ in range(150):
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2))
        k = rng.randrange(len(a) + 1)
        b += a[k : k + rng.randrange(20)]
        assert transcripts.longest_common(a, b, True) == plain_common(a, b)
        if "N" not in b:
            assert transcripts.longest_common(a, b) == plain_common(a, b)


def test_consensus_cases():
    c = lambda a, b, **o: transcripts.cds_consensus(a, b, ("t", "x"), overlap=3, **o)
    assert c("AACCC", "CCCGG") == ("AACCCGG", "t.x") and c("CCCGG", "AACCC") == ("AACCCGG", "x.t")
    assert c("AACCCGG", "CCC") == ("AACCCGG", "t<x") and c("CCC", "AACCCGG") == ("AACCCGG", "x<t")
    assert c("TACCCGT", "GACCCGA") == ("TACCCGT", "t-mismatches") and c("TACCCGT", "GACCCGA", priority=2) == ("GACCCGA", "x-mismatches")
    assert c("AAAA", "CCCC") == ("AAAA", "t-noover") and c("AACC", "CCAA", priority=2) == ("CCAA", "x-noover")
    assert c("AACCCT", "CNCTGG") == ("AACNCTGG", "t.x")


def test_consensus_of_rows(spark):
    df = spark.createDataFrame([(1, "AACCC", "CCCGG"), (2, None, "CC"), (3, "AA", None), (4, None, None)], "id long, first string, second string")
    assert sorted(map(tuple, transcripts.consensus_of(df, overlap=3).collect())) == [(1, "AACCCGG", "transdecoder.blastx"), (2, "CC", None), (3, "AA", None), (4, None, None)]

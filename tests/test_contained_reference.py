"""Reference clusters held by one cluster: rarest members first, whatever the others are."""

import random

from pyspark.sql import functions as F

from panweave.operators import clusters as C


def _plain(ref, held):
    sets = {}
    for c, m in held:
        sets.setdefault(c, set()).add(m)
    of = {}
    for r, m in ref:
        if m is not None:
            of.setdefault(r, set()).add(m)
    out = {r: [c for c, x in sets.items() if ms <= x] for r, ms in of.items()}
    return {(r, cs[0]) for r, cs in out.items() if len(cs) == 1}


def test_contained_in_one_equals_sets(spark):
    rng = random.Random(2)
    held = [(c, m) for c in range(30) for m in rng.sample(range(40), rng.randint(1, 25))]
    ref = [(r, m) for r in range(200) for m in rng.sample(range(42), rng.randint(1, 5))] + [(1, None), (500, None)] * 2 + [(7, 3), (7, 3)]
    got = C.contained_in_one(spark.createDataFrame(ref, "ref_id long, seq_id long"), spark.createDataFrame(held + held[:9], "cluster_id long, seq_id long"))
    want = _plain(ref, held)
    assert {tuple(r) for r in got.select("ref_id", "cluster_id").collect()} == want and len(want) > 10


def test_a_member_that_all_clusters_have(spark):
    """3,000 clusters share a member that 3,000 references have, and each has one of its own."""
    n = 3000
    each = spark.range(n).select(F.col("id").alias("c"), F.explode(F.array(F.lit(-1).cast("long"), F.col("id"))).alias("seq_id"))
    found = C.contained_in_one(each.withColumnRenamed("c", "ref_id"), each.withColumnRenamed("c", "cluster_id"))
    rows = found.withColumn("same", F.col("ref_id") == F.col("cluster_id")).agg(F.count(F.lit(1)), F.min("same")).first()
    assert tuple(rows) == (n, True)

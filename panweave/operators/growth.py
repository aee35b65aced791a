"""Pan- and core-genome growth: one cumulative window over (sample, cluster), for all samples at once.

orders(sample, g, taxon) lists the taxa of each sample in order of addition, g from 0. It has samples * taxa rows, while
the pangenome may be large: the join multiplies the pangenome by the number of samples and shuffles it once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Ranks of orders are spread by this prime, which divides no n! - 1 of up to 20 taxa.
SPREAD = (1 << 61) - 1


def order_of(taxa: Column, digits: Column) -> Column:
    """The permutation of an array that factorial digits name: digit i takes the (digit + 1)-th of those that are left."""
    kind = "array<string>"
    start = F.struct(F.array().cast(kind).alias("out"), taxa.cast(kind).alias("rest"))
    take = lambda s, d: F.struct(F.concat(s["out"], F.slice(s["rest"], d + 1, F.lit(1))).alias("out"), F.concat(F.slice(s["rest"], F.lit(1), d), F.slice(s["rest"], d + 2, F.size(s["rest"]))).alias("rest"))
    return F.aggregate(digits, start, take)["out"]


def permutations(spark: SparkSession, taxa: list[str], samples: int = 10, seed: int = 0) -> DataFrame:
    """(sample, g, taxon): sample 0 keeps the given order, the others are distinct; at most as many as there are orders.

    A sample is a rank below n!, and its digits in the factorial number system are the order. Ranks go round in equal
    steps of a prime from a start that the seed names, so no two are equal. Of more than 20 taxa the last 20 are placed by
    the rank and those before them by hashes, with sample 0 as it is.
    """
    n, low = len(taxa), min(len(taxa), 20)
    whole = math.factorial(low)
    others = max(1, whole - 1)
    number = lambda v: f"cast('{v}' as decimal(20, 0))"
    rank = f"CASE WHEN sample = 0 THEN 0L ELSE 1L + cast(pmod(cast(sample - 1 as decimal(16, 0)) * {number(SPREAD % others)} + {number(seed * 1_000_003 % others)}, {number(others)}) as bigint) END"
    rows = spark.range(min(samples, whole)).withColumnRenamed("id", "sample").withColumn("rank", F.expr(rank))
    far = [F.when(F.col("sample") == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "sample"), F.lit(n - i)).cast("int")) for i in range(n - low)]
    near = [F.expr(f"cast((rank div {math.factorial(low - 1 - i)}L) % {low - i} as int)") for i in range(low)]
    own = rows.select(F.col("sample").cast("int").alias("sample"), order_of(F.array(*[F.lit(t) for t in taxa]), F.array(*far, *near)).alias("o"))
    return own.select("sample", F.posexplode("o").alias("g", "taxon"))


def growth(pan: DataFrame, orders: DataFrame, soft_core: float | None = None) -> DataFrame:
    """(sample, g, core, pan[, soft]): clusters in all taxa so far, in any, and in at least the soft-core share of them."""
    present = pan.filter("n > 0").select("taxon", "cluster").distinct().join(orders, "taxon")
    run = W.partitionBy("sample", "cluster").orderBy("g").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("sample", "cluster").orderBy("g")
    seen = present.withColumns({"k": F.count(F.lit(1)).over(run), "next_g": F.lead("g").over(after)})
    core = F.sum(F.when(F.col("k") == F.col("g") + 1, 1).otherwise(0))
    new = F.sum(F.when(F.col("k") == 1, 1).otherwise(0))
    base = seen.groupBy("sample", "g").agg(core.cast("long").alias("core"), new.cast("long").alias("new"))
    out = orders.select("sample", "g").distinct().join(base, ["sample", "g"], "left").fillna(0, ["core", "new"])
    out = out.withColumn("pan", F.sum("new").over(W.partitionBy("sample").orderBy("g").rowsBetween(W.unboundedPreceding, 0)))
    if soft_core is None:
        return out.select("sample", "g", "core", "pan")
    # A cluster with k taxa counts as soft core at every g from its k-th taxon on, until k are too few or it has k + 1.
    # Per sample, k, and these two ends the clusters are counted first; the stretch is one row in and one row out.
    last = F.coalesce(F.col("next_g") - 1, F.col("n_g") - 1)
    sizes = orders.groupBy("sample").agg((F.max("g") + 1).alias("n_g"))
    kinds = seen.groupBy("sample", "k", "g", "next_g").agg(F.count(F.lit(1)).alias("n")).join(sizes, "sample").withColumn("last", last)
    # the last g that k taxa are enough for: taxa of it times the share, rounded down, is at most k
    enough = F.aggregate(F.sequence(F.col("g"), F.col("last")), F.col("g") - 1, lambda m, at: F.when(F.floor((at + 1) * F.lit(soft_core)) <= F.col("k"), at).otherwise(m))
    held = kinds.withColumn("upto", enough).filter("upto >= g")
    turns = held.select("sample", "g", F.col("n").alias("d")).unionByName(held.select("sample", (F.col("upto") + 1).alias("g"), (-F.col("n")).alias("d")))
    turns = turns.groupBy("sample", "g").agg(F.sum("d").alias("d"))
    along = W.partitionBy("sample").orderBy("g").rowsBetween(W.unboundedPreceding, 0)
    out = out.join(turns, ["sample", "g"], "left").withColumn("soft", F.sum(F.coalesce("d", F.lit(0))).over(along).cast("long"))
    return out.select("sample", "g", "core", "pan", "soft")


def extra_copies(clusters: DataFrame) -> DataFrame:
    """(seq_id) of the genes whose taxon has two or more in their cluster, but for the cluster's first gene of all."""
    many = clusters.withColumns({"k": F.count(F.lit(1)).over(W.partitionBy("cluster_id", "taxon")), "first": F.min("seq_id").over(W.partitionBy("cluster_id"))})
    return many.filter("k > 1 AND seq_id <> first").select("seq_id").distinct()


def later_copies(clusters: DataFrame) -> DataFrame:
    """(seq_id) of the genes that aren't the first of their taxon in their cluster."""
    return clusters.withColumn("first", F.min("seq_id").over(W.partitionBy("cluster_id", "taxon"))).filter("seq_id <> first").select("seq_id").distinct()


def initial_size(genes: DataFrame, extras: DataFrame, orders: DataFrame) -> DataFrame:
    """(sample, g = 0, core, pan): genes of a sample's first taxon that aren't extra copies, where both curves begin."""
    kept = genes.join(extras, "seq_id", "left_anti").join(orders.filter("g = 0"), "taxon").groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    return orders.select("sample").distinct().join(kept, "sample", "left").select("sample", F.lit(0).alias("g"), *[F.coalesce("n", F.lit(0)).cast("long").alias(c) for c in ("core", "pan")])


def star_core(orthologs: DataFrame, orders: DataFrame) -> DataFrame:
    """(sample, g, core) for g > 0: genes of a sample's first taxon with an ortholog in every taxon added up to g.

    orthologs(seq_id, taxon, other): a gene, its taxon, and a taxon in which it has a reciprocal best hit.
    """
    first = orders.filter("g = 0").select("sample", "taxon")
    met = orthologs.distinct().join(first, "taxon").join(orders.select("sample", "g", F.col("taxon").alias("other")), ["sample", "other"])
    seen = met.withColumn("k", F.row_number().over(W.partitionBy("sample", "seq_id").orderBy("g")))
    core = seen.filter("k = g").groupBy("sample", "g").agg(F.count(F.lit(1)).alias("core"))
    return orders.filter("g > 0").select("sample", "g").join(core, ["sample", "g"], "left").select("sample", "g", F.coalesce("core", F.lit(0)).cast("long").alias("core"))


def pan_increments(genes: DataFrame, homologs: DataFrame, extras: DataFrame, orders: DataFrame) -> DataFrame:
    """Genes of each added taxon without a homolog in any earlier taxon that aren't extra copies in a cluster.

    genes(seq_id, taxon), homologs(q, ts): taxa in which a gene has a homolog, extras(seq_id): non-first copies.
    """
    g = genes.join(extras, "seq_id", "left_anti").join(orders, "taxon")
    earlier = homologs.select(F.col("q").alias("seq_id"), F.col("ts").alias("taxon")).join(orders.withColumnRenamed("g", "h"), "taxon").groupBy("seq_id", "sample").agg(F.min("h").alias("first"))
    new = g.join(earlier, ["seq_id", "sample"], "left").filter("first IS NULL OR first >= g")
    return new.groupBy("sample", "g").agg(F.count(F.lit(1)).alias("new"))

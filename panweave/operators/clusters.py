"""Set operators on clusters: output filters, identity keys, intersection, sectors, singletons, synteny, containment.

clusters: cluster_id, seq_id, taxon. Members of one cluster share a partition after the first aggregate; nothing is
collected but the members of one cluster, and keys are hashed so that set comparison is one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.tables import Tables


def copy_number(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id", "taxon").agg(F.count(F.lit(1)).alias("n"))


def min_taxa(clusters: DataFrame, t: int) -> DataFrame:
    """Clusters that span at least t taxa; 0 keeps all."""
    keep = clusters.groupBy("cluster_id").agg(F.count_distinct("taxon").alias("taxa")).filter(F.col("taxa") >= t)
    return clusters.join(keep.select("cluster_id"), "cluster_id", "left_semi")


def without_inparalogs(clusters: DataFrame) -> DataFrame:
    bad = copy_number(clusters).filter("n > 1").select("cluster_id").distinct()
    return clusters.join(bad, "cluster_id", "left_anti")


def similar_length(clusters: DataFrame, percent: float, min_size: int) -> DataFrame:
    """clusters with length and place: members whose length is at least `percent` of the longer of itself and the first
    member stay; a cluster stays if at least min_size do."""
    first = F.first("length").over(W.partitionBy("cluster_id").orderBy("place"))
    marked = clusters.withColumn("_ok", 100 * F.least("length", first) >= percent * F.greatest("length", first)).filter("_ok")
    return marked.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("cluster_id"))).filter(F.col("_n") >= min_size).drop("_ok", "_n")


def single_copy(clusters: DataFrame, t: int) -> DataFrame:
    keep = clusters.groupBy("cluster_id").agg(F.count_distinct("taxon").alias("taxa"), F.count(F.lit(1)).alias("size")).filter((F.col("taxa") >= t) & (F.col("taxa") == F.col("size")))
    return clusters.join(keep.select("cluster_id"), "cluster_id", "left_semi")


def only_taxa(clusters: DataFrame, taxa: DataFrame, n_taxa: int) -> DataFrame:
    """Members of listed taxa; a cluster stays if it has exactly as many of them as the list is long."""
    kept = clusters.join(taxa.select("taxon").distinct(), "taxon", "left_semi").select(*clusters.columns)
    return kept.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("cluster_id"))).filter(F.col("_n") == n_taxa).drop("_n")


def set_key(member: Column, trim: int = 0) -> Column:
    """A cluster's identity: its members, cut by `trim` characters at both ends, sorted and hashed. For groupBy().agg()."""
    cut = member.substr(F.lit(trim + 1), F.greatest(F.length(member) - 2 * trim, F.lit(0))) if trim else member
    return F.sha2(F.array_join(F.sort_array(F.collect_list(cut)), " "), 256)


def keyed(sets: DataFrame, member: Column, trim: int = 0) -> DataFrame:
    """sets(dir, cluster_id, ...) -> (dir, cluster_id, key, size); keys that repeat within a dir are dropped.

    A key that very many clusters have is counted in partial aggregates, so its clusters never meet in one task.
    """
    keys = sets.groupBy("dir", "cluster_id").agg(set_key(member, trim).alias("key"), F.count(F.lit(1)).alias("size"))
    once = keys.groupBy("dir", "key").agg(F.min("cluster_id").alias("cluster_id"), F.min("size").alias("size"), F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    return once.select("dir", "cluster_id", "key", "size")


def intersection(keys: DataFrame, n_dirs: int, exactly: bool = True) -> DataFrame:
    """Keys that n_dirs dirs have (that many or more if not exactly), with the smallest cluster id."""
    g = keys.groupBy("key").agg(F.count_distinct("dir").alias("dirs"), F.min("cluster_id").alias("cluster_id"), F.max("size").alias("size"))
    return g.filter(F.col("dirs") == n_dirs if exactly else F.col("dirs") >= n_dirs).drop("dirs")


def sectors(keys: DataFrame, dirs: list[str]) -> DataFrame:
    """(sector, n): how many keys lie in exactly that subset of the dirs; bit i stands for dirs[i]."""
    bit = F.lit(0)
    for i, d in enumerate(dirs):
        bit = bit + F.when(F.col("dir") == d, F.lit(1 << i)).otherwise(F.lit(0))
    return keys.select("key", bit.cast("long").alias("b")).distinct().groupBy("key").agg(F.sum("b").alias("sector")).groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


def singletons(sequences: DataFrame, clusters: DataFrame) -> DataFrame:
    return sequences.join(clusters.select("seq_id"), "seq_id", "left_anti")


def small_cluster_members(sequences: DataFrame, clusters: DataFrame, t: int) -> DataFrame:
    """Sequences that are in no cluster of at least t taxa, counted by taxon."""
    return singletons(sequences, min_taxa(clusters, t)).groupBy("taxon").agg(F.count(F.lit(1)).alias("n"))


def syntenic(clusters: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Clusters for which another cluster with the same taxa has, in each taxon, a member next to one of its own.

    neighbours(seq_id, neighbour): both directions.
    """
    taxa = clusters.groupBy("cluster_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("taxon")), "\u0001"), 256).alias("taxa"), F.count_distinct("taxon").alias("n_taxa"))
    own = clusters.join(neighbours, "seq_id").select("cluster_id", "taxon", F.col("neighbour").alias("seq_id"))
    met = own.join(clusters.select(F.col("cluster_id").alias("other"), "seq_id"), "seq_id").filter("cluster_id <> other")
    pairs = met.groupBy("cluster_id", "other").agg(F.count_distinct("taxon").alias("met"))
    x = taxa.select("cluster_id", "taxa", "n_taxa")
    y = taxa.select(F.col("cluster_id").alias("other"), F.col("taxa").alias("other_taxa"))
    return pairs.join(x, "cluster_id").join(y, "other").filter("taxa = other_taxa AND met = n_taxa").select("cluster_id").distinct()


def contained_in_one(reference: DataFrame, clusters: DataFrame, member: str = "seq_id") -> DataFrame:
    """Reference clusters all of whose members are in exactly one cluster: (ref_id, cluster_id).

    A cluster that holds them all holds the two that the fewest clusters have, so only the clusters of the rarest member are
    looked at, those of them that have the next one go on, and the other members are counted in these alone.
    """
    tables = Tables(reference.sparkSession, "held")
    held = tables.save(clusters.select(member, "cluster_id").filter(F.col(member).isNotNull()).distinct())
    often = held.groupBy(member).agg(F.count(F.lit(1)).alias("_often"))
    own = reference.select("ref_id", member).filter(F.col(member).isNotNull()).distinct().join(often, member, "left")
    own = tables.save(own.select("ref_id", member, F.struct(F.coalesce("_often", F.lit(0)).alias("n"), F.col(member).alias("m")).alias("_place")))
    first = own.groupBy("ref_id").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("size"))
    later = tables.save(own.join(first, "ref_id"))
    second = later.filter("_place <> _first").groupBy("ref_id").agg(F.min("_place").alias("_second"))
    chosen = tables.save(first.join(second, "ref_id", "left").select("ref_id", "size", F.col("_first.m").alias("_one"), F.col("_second.m").alias("_two")))
    found = chosen.join(held.withColumnRenamed(member, "_one"), "_one").select("ref_id", "size", "_two", "cluster_id")
    both = tables.save(found.filter("size > 1").join(held.withColumnRenamed(member, "_two"), ["_two", "cluster_id"], "left_semi").select("ref_id", "size", "cluster_id"))
    rest = later.join(chosen.select("ref_id", "_one", "_two"), "ref_id").filter((F.col(member) != F.col("_one")) & (F.col(member) != F.col("_two"))).select("ref_id", member)
    asked = both.filter("size > 2").join(rest, "ref_id").join(held, [member, "cluster_id"], "left_semi")
    full = asked.groupBy("ref_id", "cluster_id", "size").agg(F.count(F.lit(1)).alias("n")).filter("n = size - 2")
    whole = found.filter("size = 1").select("ref_id", "cluster_id").unionByName(both.filter("size = 2").select("ref_id", "cluster_id")).unionByName(full.select("ref_id", "cluster_id"))
    return whole.groupBy("ref_id").agg(F.count(F.lit(1)).alias("k"), F.min("cluster_id").alias("cluster_id")).filter("k = 1").drop("k")


def intergenic_clusters(segments: DataFrame, clusters: DataFrame) -> DataFrame:
    """segments(seg_id, taxon, left_gene, right_gene, left_strand, right_strand): groups of segments whose neighbours on
    both sides lie in the same two clusters with equal or both inverted strands and as many as the clusters have members."""
    of = clusters.select(F.col("seq_id"), F.col("cluster_id"))
    s = segments.join(of.select(F.col("seq_id").alias("left_gene"), F.col("cluster_id").alias("lc")), "left_gene").join(
        of.select(F.col("seq_id").alias("right_gene"), F.col("cluster_id").alias("rc")), "right_gene")
    flip = (F.col("lc") > F.col("rc")) | ((F.col("lc") == F.col("rc")) & (F.col("left_strand") < F.col("right_strand")))
    turned = s.select("seg_id", F.least("lc", "rc").alias("c1"), F.greatest("lc", "rc").alias("c2"),
                      F.when(flip, -F.col("right_strand")).otherwise(F.col("left_strand")).alias("s1"), F.when(flip, -F.col("left_strand")).otherwise(F.col("right_strand")).alias("s2"))
    size = clusters.groupBy(F.col("cluster_id").alias("c1")).agg(F.count(F.lit(1)).alias("size"))
    groups = turned.groupBy("c1", "c2", "s1", "s2").agg(F.sort_array(F.collect_list("seg_id")).alias("segments")).join(size, "c1")
    return groups.filter(F.size("segments") == F.col("size")).select("c1", "c2", "segments")


def leading_number(name: Column) -> Column:
    """The whole number that a name begins with, null if it has none."""
    return F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit("")).cast("long")


def by_leading_number(names: DataFrame) -> DataFrame:
    """Clusters in order of the whole number their names begin with; names without one come first."""
    return names.orderBy(F.asc_nulls_first(leading_number(F.col("name"))), "name")

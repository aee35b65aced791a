"""Whole analyses as plans: from hits to clusters and matrices, comparison of cluster sets, pairs to clusters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panweave.config import Config
from panweave.operators import clusters as C
from panweave.operators import graph, growth, homology, matrix, sequences
from panweave.tables import Tables


@dataclass
class Result:
    clusters: DataFrame
    pangenome: DataFrame
    identity: DataFrame
    pocp: DataFrame
    compartments: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


def smallest_taxon(seqs: DataFrame) -> str:
    """The reference by default: the taxon with the fewest sequences, the first by name on ties."""
    return seqs.groupBy("taxon").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "taxon").first()["taxon"]


def cluster(spark: SparkSession, hits: DataFrame, seqs: DataFrame, cfg: Config, algorithm: str = "omcl", reference: str | None = None) -> DataFrame:
    """(cluster_id, seq_id, taxon) by reference best hits (bdbh), Markov clustering (omcl) or triangles (cog)."""
    tables, taxa = Tables(spark, algorithm), seqs.select("seq_id", "taxon")
    if algorithm == "bdbh":
        return homology.bdbh_clusters(hits, taxa, reference or smallest_taxon(seqs), cfg)
    if algorithm == "omcl":
        found = graph.mcl(tables, tables.save(homology.omcl_edges(hits, cfg).select("a", "b", "w")), cfg.inflation)
        return found.select(F.col("cluster").alias("cluster_id"), F.col("node").alias("seq_id")).join(taxa, "seq_id").select("cluster_id", "seq_id", "taxon")
    if algorithm == "cog":
        pairs = tables.save(homology.reciprocal(homology.best(hits, cfg), cfg))
        return graph.allot(graph.triangle_clusters(tables, pairs), taxa).join(taxa, "seq_id").select("cluster_id", "seq_id", "taxon")
    raise ValueError(algorithm)


def run(spark: SparkSession, hits: DataFrame, seqs: DataFrame, cfg: Config, algorithm: str = "omcl", min_taxa: int = 0, exclude_inparalogs: bool = False, domains: DataFrame | None = None, reference: str | None = None) -> Result:
    """hits (with rk) and seqs(seq_id, taxon, seq) to clusters and matrices; min_taxa 0 adds singletons as clusters."""
    tables = Tables(spark, "run")
    found = cluster(spark, hits, seqs, cfg, algorithm, reference)
    if domains is not None:
        found = graph.split_by_attribute(found.select("cluster_id", "seq_id"), domains).join(seqs.select("seq_id", "taxon"), "seq_id").select("cluster_id", "seq_id", "taxon")
    if min_taxa == 0:
        found = tables.save(found)
        found = found.unionByName(C.singletons(seqs.select("seq_id", "taxon"), found).select(F.col("seq_id").alias("cluster_id"), "seq_id", "taxon"))
    kept = C.min_taxa(found, min_taxa)
    kept = tables.save((C.without_inparalogs(kept) if exclude_inparalogs else kept).select("cluster_id", "seq_id", "taxon"))
    pan = tables.save(C.copy_number(kept).select("taxon", F.col("cluster_id").cast("string").alias("cluster"), "n"))
    totals = seqs.groupBy("taxon").agg(F.count(F.lit(1)).alias("total"))
    taxa = seqs.select("taxon").distinct()
    return Result(kept, pan, matrix.square(matrix.clustered_identity(kept, hits), taxa, "ani"), matrix.square(matrix.pocp(pan, totals), taxa, "pocp"), matrix.compartments(pan, cfg.soft_core))


def transcripts(spark: SparkSession, hits: DataFrame, seqs: DataFrame, spans: DataFrame, cfg: Config | None = None, algorithm: str = "omcl", min_taxa: int = 2, samples: int | None = None, seed: int = 0) -> Result:
    """The transcript analysis: isoforms go first, one side's coverage is enough, growth leaves cloud genes out.

    spans: hits of single segments for isoform_pairs(). Of a taxon's isoforms the first in order absorbs the others; hits
    and sequences without the absorbed ones are clustered. extra holds the redundant sequences, the cloud genes (in no
    cluster of min_taxa taxa), the initial sizes and the increments of the growth curves.
    """
    cfg, tables = cfg or Config.transcripts(), Tables(spark, "transcripts")
    redundant = tables.save(graph.greedy_absorb(homology.isoform_pairs(spans, cfg), "tq"))
    lone = seqs.join(redundant.select("seq_id"), "seq_id", "left_anti")
    kept = tables.save(homology.ranked(sequences.without_redundant(hits, redundant).drop("rk")))
    out = run(spark, kept, lone, cfg, algorithm, min_taxa)
    genes = lone.select("seq_id", "taxon")
    cloud = tables.save(C.singletons(genes, out.clusters).select("seq_id"))
    taxa = [r[0] for r in genes.select("taxon").distinct().orderBy("taxon").collect()]  # one row a taxon
    orders = growth.permutations(spark, taxa, samples or cfg.growth_samples, seed)
    homologs = homology.homologs(kept, cfg).select("q", "ts")
    counted = genes.join(cloud, "seq_id", "left_anti")
    out.extra |= {
        "redundant": redundant, "cloud": cloud, "initial": growth.initial_size(counted, growth.later_copies(out.clusters), orders),
        "increments": growth.pan_increments(counted, homologs, growth.extra_copies(out.clusters), orders),
    }
    return out


def nonredundant(tables: Tables, pan: DataFrame, lengths: DataFrame, pairs: DataFrame, identity: float, coverage: float, short: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The non-redundant pangenome: (taxon, cluster, n), (cluster, name, members) and clusters in order of length.

    lengths(cluster, length) of the representatives; pairs(q, s, pident, qcov, scov) between them. The longer of two
    similar clusters (the first by name on ties) absorbs the other; coverage is that of the longer one, or of the shorter.
    Clusters that none absorbs stay. Their counts add those that they absorb themselves, one level; their names list all
    that hang on them, over all levels.
    """
    size = lengths.select("cluster", "length")
    both = pairs.join(size.select(F.col("cluster").alias("q"), F.col("length").alias("lq")), "q").join(size.select(F.col("cluster").alias("s"), F.col("length").alias("ls")), "s")
    query_side = (F.col("lq") < F.col("ls")) if short else (F.col("lq") > F.col("ls"))
    cover = F.when(query_side, F.col("qcov")).otherwise(F.col("scov"))
    later = (F.col("lq") < F.col("ls")) | ((F.col("lq") == F.col("ls")) & (F.col("q") > F.col("s")))  # q comes after s
    direct = tables.save(both.filter(later & (F.col("pident") >= identity) & (cover >= coverage)).select(F.col("s").alias("keep"), F.col("q").alias("gone")).distinct())
    gone = direct.select(F.col("gone").alias("cluster")).distinct()
    stays = tables.save(size.join(gone, "cluster", "left_anti"))
    own = pan.select("taxon", "cluster", "n")
    added = own.withColumnRenamed("cluster", "gone").join(direct, "gone").select("taxon", F.col("keep").alias("cluster"), "n")
    counts = own.unionByName(added).join(stays.select("cluster"), "cluster", "left_semi").groupBy("taxon", "cluster").agg(F.sum("n").alias("n"))

    # all levels: what a kept cluster reaches, a round a level
    reach = front = tables.save(direct.join(stays.select(F.col("cluster").alias("keep")), "keep", "left_semi").select(F.col("keep").alias("root"), "gone"))
    while not front.isEmpty():
        step = front.select("root", F.col("gone").alias("keep")).join(direct, "keep").select("root", "gone").distinct()
        front = tables.save(step.join(reach, ["root", "gone"], "left_anti"))
        reach = tables.save(reach.unionByName(front))
    held = reach.groupBy(F.col("root").alias("cluster")).agg(F.sort_array(F.collect_set("gone")).alias("members"))
    named = stays.select("cluster").join(held, "cluster", "left").withColumn("members", F.coalesce("members", F.array().cast(held.schema["members"].dataType)))
    name = F.when(F.size("members") > 0, F.concat(F.col("cluster").cast("string"), F.lit("+"), F.size("members").cast("string"))).otherwise(F.col("cluster").cast("string"))
    return counts, named.select("cluster", name.alias("name"), "members"), stays.orderBy(F.desc("length"), "cluster")


def compare(sets: DataFrame, dirs: list[str], trim: int = 3) -> tuple[DataFrame, DataFrame]:
    """sets(dir, cluster_id, member): the clusters that all dirs share, and the sectors of their diagram."""
    keys = C.keyed(sets.filter(F.col("dir").isin(dirs)), F.col("member"), trim)
    return C.intersection(keys, len(dirs)), C.sectors(keys, dirs)


def simulate_growth(spark: SparkSession, pan: DataFrame, cfg: Config, seed: int = 0) -> DataFrame:
    taxa = [r[0] for r in pan.select("taxon").distinct().orderBy("taxon").collect()]  # one row a taxon
    return growth.growth(pan, growth.permutations(spark, taxa, cfg.growth_samples, seed), cfg.soft_core)


def pairs_to_clusters(tables: Tables, pairs: DataFrame) -> DataFrame:
    """pairs(ord, a, b) in file order -> (cluster_id, member): a pair joins its second gene to the first one's cluster.

    Two clusters that exist already never merge, so a gene's cluster is settled by the first pair that names it: it hangs
    on the other gene of that pair if that one was named before, else both hang on the pair's first gene, which is a
    cluster's root. Those parents are a forest, and jumping from parents to their parents finds all roots in as many rounds
    as the logarithm of its depth. ord is unique.
    """
    pair = F.struct("ord", "a", "b")
    named = pairs.select(pair.alias("pair"), F.explode(F.array("a", "b")).alias("gene")).groupBy("gene").agg(F.min("pair").alias("pair"))
    first = tables.save(named.select("gene", "pair.*").withColumn("other", F.when(F.col("gene") == F.col("a"), F.col("b")).otherwise(F.col("a"))))
    others = first.select(F.col("gene").alias("other"), F.col("ord").alias("other_ord"))
    met = first.join(others, "other")
    up = tables.save(met.select("gene", F.when(F.col("other_ord") == F.col("ord"), F.col("a")).otherwise(F.col("other")).alias("root")))
    for _ in range(graph.MAX_ROUNDS):
        above = up.select(F.col("gene").alias("root"), F.col("root").alias("next"))
        new = tables.save(up.join(above, "root").select("gene", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        settled = new.filter("moved").isEmpty()
        tables.drop(up)
        up = new
        if settled:
            return up.select(F.col("root").cast("string").alias("cluster_id"), F.col("gene").cast("string").alias("member"))
    raise RuntimeError(f"the forest of first pairs is deeper than 2 ** {graph.MAX_ROUNDS}")

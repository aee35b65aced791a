"""The hits algebra: best and reciprocal hits, inparalogs, seeds, homologs, cluster assembly and graph weights.

hits: q, s, tq, ts (taxa of both), evalue, pident, qcov, scov, bits, rk (place in the query's list). All orders are
explicit: rk is row_number by E-value with the subject id as last key, so results don't depend on file order. Filters and
window ranks are declarative, and every self-join is an equi-join on ids, so partitioning by q serves the windows and the
joins alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.config import Config
from panweave.functions import profiles
from panweave.tables import Tables


def ranked(hits: DataFrame, own_first: bool = False) -> DataFrame:
    """Adds rk: by E-value; with own_first the query's own taxon comes first inside a tie."""
    order = [F.asc("evalue"), *([F.asc(F.col("ts") != F.col("tq"))] if own_first else []), F.asc("s")]
    return hits.withColumn("rk", F.row_number().over(W.partitionBy("q").orderBy(*order)))


def coverage_ok(cfg: Config, q: Column | None = None, s: Column | None = None) -> Column:
    q, s = F.col("qcov") if q is None else q, F.col("scov") if s is None else s
    if not cfg.coverage:
        return F.lit(True)
    return (F.greatest(q, s) if cfg.short_coverage else F.least(q, s)) >= cfg.coverage


def weight(evalue: Column, cfg: Config) -> Column:
    """-log10(E), with the largest weight for an E-value of 0."""
    return F.when(evalue == 0, F.lit(cfg.max_weight)).otherwise(-F.log10(evalue))


def top_ties(hits: DataFrame) -> DataFrame:
    """Of each query and foreign taxon the hits that tie for the lowest E-value."""
    foreign = hits.filter("tq <> ts")
    first = F.rank().over(W.partitionBy("q", "ts").orderBy("evalue"))
    return foreign.withColumn("_r", first).filter("_r = 1").drop("_r")


def collapse_to_seeds(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """Query and subject replaced by their inparalog seed; mapped once, also where a seed has a seed itself."""
    for side in ("q", "s"):
        mapped = seeds.select(F.col("seq_id").alias(side), F.col("seed").alias("_seed"))
        hits = hits.join(mapped, side, "left").withColumn(side, F.coalesce("_seed", side)).drop("_seed")
    return hits


def best(hits: DataFrame, cfg: Config, domains: DataFrame | None = None, rescue: bool = False, first_only: bool = False, tied: bool = False) -> DataFrame:
    """Best hits between taxa that pass the cutoffs. tied: hits are top_ties() already.

    rescue: poor coverage or E-value is accepted if the reverse hit among the ties passes. domains(seq_id, domains): both
    ends must carry the same domain string (missing counts as empty). first_only: one surviving row a query and taxon;
    ties in rk, which hits collapsed to seeds can have, go by E-value, subject and the rest of the row.
    """
    ties = hits if tied else top_ties(hits)
    if domains is not None:
        for side in ("q", "s"):
            ties = ties.join(domains.select(F.col("seq_id").alias(side), F.col("domains").alias(f"d{side}")), side, "left")
        ties = ties.filter(F.coalesce("dq", F.lit("")) == F.coalesce("ds", F.lit(""))).drop("dq", "ds")
    good_cover, good_e = coverage_ok(cfg), F.col("evalue") <= cfg.evalue
    if rescue:
        back = ties.groupBy(F.col("s").alias("q"), F.col("q").alias("s")).agg(
            F.min(F.struct("rk", "evalue", "qcov", "scov")).alias("back"))
        ties = ties.join(back, ["q", "s"], "left")
        good_cover = good_cover | F.coalesce(coverage_ok(cfg, F.col("back.qcov"), F.col("back.scov")), F.lit(False))
        good_e = good_e | F.coalesce(F.col("back.evalue") <= cfg.evalue, F.lit(False))
    out = ties.filter((F.col("pident") >= cfg.identity) & good_cover & good_e)
    out = out.drop("back") if rescue else out
    if first_only:
        out = out.withColumn("_n", F.row_number().over(W.partitionBy("q", "ts").orderBy("rk", "evalue", "s", "pident", "qcov", "scov"))).filter("_n = 1").drop("_n")
    return out


def reciprocal(hits: DataFrame, cfg: Config) -> DataFrame:
    """(a, b, ta, tb, w): pairs present in both directions, each unordered pair once with a < b."""
    x = hits.select(F.col("q").alias("a"), F.col("s").alias("b"), F.col("tq").alias("ta"), F.col("ts").alias("tb"), F.col("evalue").alias("e1")).dropDuplicates(["a", "b"])
    y = hits.select(F.col("s").alias("a"), F.col("q").alias("b"), F.col("evalue").alias("e2")).dropDuplicates(["a", "b"])
    pairs = x.filter("a < b").join(y, ["a", "b"])
    return pairs.select("a", "b", "ta", "tb", ((weight(F.col("e1"), cfg) + weight(F.col("e2"), cfg)) / 2).alias("w"))


def _stops(cfg: Config | None = None) -> Column:
    """How many hits up to this one of the query are foreign (or, with cutoffs, fail them)."""
    stop = F.col("ts") != F.col("tq")
    if cfg is not None:
        stop = stop | ((F.col("q") != F.col("s")) & ((F.col("evalue") > cfg.evalue) | (F.col("pident") < cfg.identity)))
    return F.sum(stop.cast("int")).over(W.partitionBy("q").orderBy("rk").rowsBetween(W.unboundedPreceding, 0))


def prefix_before_foreign(hits: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Own hits that come before the first foreign hit of the query (and, with cutoffs, before the first that fails them)."""
    out = hits.withColumn("_stops", _stops(cfg)).filter("_stops = 0 AND q <> s").drop("_stops")
    return out.filter(coverage_ok(cfg)) if cfg is not None else out


def ties_and_prefix(tables: Tables, hits: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """top_ties() and prefix_before_foreign() of hits that are read once: only rows of either are written.

    Both windows keep to the query, so hits that are dealt by it are not moved again.
    """
    foreign = F.coalesce(F.col("tq") != F.col("ts"), F.lit(False))
    first = F.rank().over(W.partitionBy("q", "ts", foreign).orderBy("evalue"))
    marked = hits.withColumns({"_stops": _stops(cfg), "_r": first})
    tie, pre = foreign & (F.col("_r") == 1), F.coalesce((F.col("_stops") == 0) & (F.col("q") != F.col("s")) & coverage_ok(cfg), F.lit(False))
    kept = tables.save(marked.withColumns({"_tie": tie, "_pre": pre}).filter("_tie OR _pre").drop("_stops", "_r"))
    return tuple(kept.filter(which).drop("_tie", "_pre") for which in ("_tie", "_pre"))


def inparalogs(hits: DataFrame, cfg: Config) -> DataFrame:
    return reciprocal(prefix_before_foreign(hits, cfg), cfg)


def seeds(pairs: DataFrame) -> DataFrame:
    """(seq_id, seed): the smallest neighbour, if it is smaller than the sequence itself; one hop, not transitive."""
    return pairs.groupBy(F.greatest("a", "b").alias("seq_id")).agg(F.min(F.least("a", "b")).alias("seed"))


def homologs(hits: DataFrame, cfg: Config) -> DataFrame:
    """The first hit of each query in each other taxon that passes the homology cutoffs."""
    ok = hits.filter((F.col("tq") != F.col("ts")) & (F.col("evalue") <= cfg.evalue) & (F.col("pident") >= cfg.homology_identity))
    ok = ok.filter((F.greatest("qcov", "scov") if cfg.short_coverage else F.least("qcov", "scov")) >= cfg.homology_coverage)
    return ok.withColumn("_n", F.row_number().over(W.partitionBy("q", "ts").orderBy("rk"))).filter("_n = 1").drop("_n")


def top_n(hits: DataFrame, n: int) -> DataFrame:
    """The first n hits of each query in each taxon."""
    return hits.withColumn("_n", F.row_number().over(W.partitionBy("q", "ts").orderBy("rk"))).filter(F.col("_n") <= n).drop("_n")


def inspect(hits: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Forward hits of some queries (n a taxon) with the reverse hit of each, where there is one."""
    forward = top_n(hits.join(queries, "q", "left_semi"), n)
    back = hits.select(F.col("q").alias("s"), F.col("s").alias("q"), F.col("rk").alias("back_rk"), F.col("evalue").alias("back_evalue"))
    return forward.join(back, ["q", "s"], "left")


def bdbh_clusters(hits: DataFrame, taxa: DataFrame, reference: str, cfg: Config) -> DataFrame:
    """(cluster_id, seq_id, taxon): bidirectional best hits of a reference taxon, with inparalogs.

    Inparalogs of every taxon are found first and hits are collapsed to their seeds; each reference gene with an ortholog
    leads a cluster of its orthologs, the inparalogs whose seed is one of them, and its own inparalogs. Hits are read once.
    The best hits of a seed are among those of the sequences that collapse to it, so only these go on. Each step that is
    read twice is written out.
    """
    tables = Tables(hits.sparkSession, "bdbh")
    own, prefix = ties_and_prefix(tables, hits, cfg)
    seed = tables.save(seeds(reciprocal(prefix, cfg)))
    ties = tables.save(top_ties(collapse_to_seeds(own, seed)))
    pairs = tables.save(reciprocal(tables.save(best(ties, cfg, rescue=True, first_only=True, tied=True)), cfg))
    star = pairs.filter(F.col("ta") == reference).select(F.col("a").alias("cluster_id"), F.col("b").alias("seq_id")).unionByName(
        pairs.filter(F.col("tb") == reference).select(F.col("b").alias("cluster_id"), F.col("a").alias("seq_id"))).distinct()
    star = tables.save(star)
    core = star.unionByName(star.select("cluster_id", F.col("cluster_id").alias("seq_id")).distinct())
    extra = core.join(seed.select(F.col("seed").alias("seq_id"), F.col("seq_id").alias("copy")), "seq_id").select("cluster_id", F.col("copy").alias("seq_id"))
    return core.unionByName(extra).distinct().join(taxa.select("seq_id", "taxon"), "seq_id").select("cluster_id", "seq_id", "taxon")


def omcl_edges(hits: DataFrame, cfg: Config) -> DataFrame:
    """(a, b, ta, tb, kind, w): ortholog and inparalog edges, each weight over the mean of its pair of taxa or taxon.

    The mean of a taxon's inparalog weights runs over pairs with an end that has an ortholog, if there are any. Best and
    prefix hits are written out, since each is joined to itself; hits are read once.
    """
    tables = Tables(hits.sparkSession, "edges")
    ties, prefix = ties_and_prefix(tables, hits, cfg)
    orth = tables.save(reciprocal(best(ties, cfg, tied=True), cfg))
    low, high = F.least("ta", "tb"), F.greatest("ta", "tb")
    orth = orth.withColumn("w", F.col("w") / F.avg("w").over(W.partitionBy(low, high))).withColumn("kind", F.lit("ortholog"))
    para = reciprocal(prefix, cfg)
    has = orth.select(F.explode(F.array("a", "b")).alias("seq_id")).distinct()
    for side in ("a", "b"):
        para = para.join(has.select(F.col("seq_id").alias(side), F.lit(True).alias(f"h{side}")), side, "left")
    linked = F.coalesce("ha", "hb").isNotNull()
    taxon = W.partitionBy("ta")
    mean = F.coalesce(F.avg(F.when(linked, F.col("w"))).over(taxon), F.avg("w").over(taxon))
    para = para.select("a", "b", "ta", "tb", (F.col("w") / mean).alias("w"), F.lit("inparalog").alias("kind"))
    return orth.select("a", "b", "ta", "tb", "kind", "w").unionByName(para.select("a", "b", "ta", "tb", "kind", "w"))


#: Hits whose profiles a block of neighbour_correlation() holds, about (five bytes each, and three packed).
BLOCK_HITS = 1 << 25


def neighbour_correlation(hits: DataFrame, pairs: DataFrame | None, cfg: Config, block_hits: int = BLOCK_HITS) -> DataFrame:
    """Pearson correlation of the rounded log bits of two sequences' hits over the union of their subjects: (a, b, r) of
    every pair once. pairs(a, b); None: all pairs that are hits, the smaller first. A pair with a null end is none.

    Scores are taken from that of a missing hit on, which moves no correlation and makes the missing ones 0: sums a sequence
    and the sum of products over shared subjects are all it takes. Sequences are dealt into groups, and a block is the
    profiles of two groups, some `block_hits` hits, with the pairs between them. So a profile, packed in bytes, travels once
    to each group and not to each of its pairs, a pair travels once, and no row a pair and subject is made. 1 where a
    profile doesn't vary; pairs without any hit are left out.
    """
    tables, spark = Tables(hits.sparkSession, "profiles"), hits.sparkSession
    missing = F.bround(F.log10(F.lit(float(cfg.min_bits))), 0)
    v = F.coalesce(F.bround(F.log10(F.max("bits")), 0) - missing, F.lit(0.0))
    scores = hits.groupBy("q", "s").agg(v.cast("int").alias("v"))
    lists = scores.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("s", "v"))).alias("p")).select("q", F.col("p.s").alias("s"), F.col("p.v").alias("v"))
    lists = tables.save(lists)
    if pairs is None:
        pairs = lists.select("q", F.explode("s").alias("s")).select(F.least("q", "s").alias("a"), F.greatest("q", "s").alias("b"))
    held = lists.agg(F.sum(F.size("s"))).first()[0] or 0
    tasks = 3 * spark.sparkContext.defaultParallelism
    groups = max(2 * held // block_hits + 1, int((2 * tasks) ** 0.5) + 1)  # blocks for all cores, none larger than it should be
    group = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.lit(groups)).cast("int")
    block = lambda g, k: F.least(g, k) * F.lit(groups) + F.greatest(g, k)
    profile = lists.filter("q IS NOT NULL").mapInArrow(profiles.pack, "q long, p binary")
    own = profile.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda k: block(group("q"), k))).alias("block"), F.col("q").alias("a"), F.lit(None).cast("long").alias("b"), "p")
    asked = pairs.filter("a IS NOT NULL AND b IS NOT NULL").select(block(group("a"), group("b")).alias("block"), "a", "b", F.lit(None).cast("binary").alias("p"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups * (groups + 1) // 2)
    rows = own.unionByName(asked).repartition(parts, "block").sortWithinPartitions("block", F.col("p").isNull(), "a", "b")
    return rows.mapInArrow(profiles.correlations, "a long, b long, r double")


def isoform_pairs(hits: DataFrame, cfg: Config) -> DataFrame:
    """Pairs (q, s) of one taxon with q < s, full identity, one segment and enough overlap without overhang.

    hits carry the aligned span of a single segment: qs, qe, ss, se, qlen, slen, n_segments.
    """
    overlap = F.least(F.col("qe") - F.col("qs"), F.col("se") - F.col("ss")) + 1
    flush = ((F.col("qs") == 1) | (F.col("ss") == 1)) & ((F.col("qe") == F.col("qlen")) | (F.col("se") == F.col("slen")))
    most = 100 * overlap >= 99 * F.least("qlen", "slen")
    return hits.filter((F.col("q") < F.col("s")) & (F.col("tq") == F.col("ts")) & (F.col("pident") == 100) & (F.col("n_segments") == 1)).filter(
        (overlap >= cfg.min_isoform_overlap) & (flush | most))

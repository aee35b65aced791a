"""The pangenome matrix in long form: taxon, cluster, n (copies, above 0).

All operators are aggregates and equi-joins over the long form; the wide form exists only at the sinks. Tables of one row
per taxon or per occupancy are tiny; joins with them are left to AQE, which broadcasts them by their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.tables import Tables


def positions(keys: DataFrame, key: str) -> DataFrame:
    """(key, pos): the distinct keys numbered from 0 in their order, without one task that sees all of them.

    Keys are dealt by range and sorted; written rows carry the number of their part and their place in it, and the parts'
    sizes (one row a part) give the offsets.
    """
    tables = Tables(keys.sparkSession, "positions")
    dealt = keys.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    rows = tables.save(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    begin = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_begin"))
    return rows.withColumn("_part", part).join(begin, "_part").select(key, (F.col("_begin") + inside).alias("pos"))


def row_texts(cells: DataFrame, row: str, col: str, text: Column, blank: str, sep: str, places: DataFrame) -> DataFrame:
    """(row, text): the cells of a row in order of their columns, with `blank` for those that it lacks.

    places: positions() of the columns. Only cells that exist are moved; the blanks between two of them come from the
    distance of their places.
    """
    total = places.agg(F.count(F.lit(1)).alias("_total"))
    held = cells.select(row, col, text.alias("_t")).join(places, col).groupBy(row).agg(F.sort_array(F.collect_list(F.struct("pos", "_t"))).alias("_v")).crossJoin(F.broadcast(total))
    before = lambda i: F.coalesce(F.get("_v", i - 1)["pos"], F.lit(-1))
    gap = lambda n: F.repeat(F.lit(blank + sep), n.cast("int"))
    pieces = F.transform("_v", lambda x, i: F.concat(gap(x["pos"] - F.when(i == 0, F.lit(-1)).otherwise(before(i)) - 1), x["_t"]))
    tail = F.repeat(F.lit(sep + blank), (F.col("_total") - 1 - F.element_at("_v", -1)["pos"]).cast("int"))
    return held.select(row, F.concat(F.array_join(pieces, sep), tail).alias("text"))


def occupancy(pan: DataFrame) -> DataFrame:
    return pan.filter("n > 0").groupBy("cluster").agg(F.count_distinct("taxon").alias("occ"))


def n_taxa(pan: DataFrame) -> DataFrame:
    return pan.agg(F.count_distinct("taxon").alias("n_taxa"))


def occupancy_histogram(pan: DataFrame) -> DataFrame:
    """(occ, n) for every occupancy from 1 to the number of taxa, with zeros."""
    every = n_taxa(pan).select(F.explode(F.sequence(F.lit(1).cast("long"), "n_taxa")).alias("occ"))
    counts = occupancy(pan).groupBy("occ").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "occ", "left").select("occ", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cut_positions(pan: DataFrame, soft_core: float = 0.95, no_cloud: bool = False) -> DataFrame:
    """One row: n_taxa, softcorepos, cloudpos.

    softcorepos is the whole part of soft_core times the taxa. cloudpos is one more than the occupancy with the most
    clusters, the first on ties, among those whose successor lies below softcorepos; -1 if there is none.
    """
    hist = occupancy_histogram(pan).crossJoin(n_taxa(pan)).withColumn("softcorepos", F.floor(F.col("n_taxa") * F.lit(soft_core)))
    low = F.when((F.col("occ") + 1 < F.col("softcorepos")) & (F.col("n") > 0), F.struct(F.col("n"), (-F.col("occ")).alias("o")))
    cloud = F.lit(0).cast("long") if no_cloud else F.coalesce(-F.max(low)["o"] + 1, F.lit(-1)).cast("long")
    return hist.groupBy("n_taxa", "softcorepos").agg(cloud.alias("cloudpos"))


def compartments(pan: DataFrame, soft_core: float = 0.95, no_cloud: bool = False) -> DataFrame:
    """(cluster, occ, compartment, core): cloud, shell or softcore; core marks clusters in all taxa (softcore as well)."""
    cut = cut_positions(pan, soft_core, no_cloud)
    named = F.when(F.col("occ") >= F.col("softcorepos"), "softcore").when(F.col("occ") <= F.col("cloudpos"), "cloud").otherwise("shell")
    return occupancy(pan).crossJoin(F.broadcast(cut)).select("cluster", "occ", named.alias("compartment"), (F.col("occ") == F.col("n_taxa")).alias("core"))


def require_taxa(pan: DataFrame, least: int = 5) -> None:
    """Compartments of fewer than five taxa aren't meaningful: an error."""
    n = n_taxa(pan).first()[0]
    if n < least:
        raise ValueError(f"compartments need at least {least} taxa, got {n}")


def taxon_occupancy(pan: DataFrame, soft_core: float = 0.95) -> DataFrame:
    """Per taxon: how many of its clusters are cloud, shell, softcore and core."""
    classed = pan.filter("n > 0").join(compartments(pan, soft_core), "cluster")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return classed.groupBy("taxon").agg(*[count(F.col("compartment") == c).alias(c) for c in ("cloud", "shell", "softcore")], count(F.col("core")).alias("core"))


def absent_in_b(pan: DataFrame, b: list[str]) -> DataFrame:
    """Clusters of no taxon in b that at least one other taxon has."""
    in_b = F.col("taxon").isin(b)
    has = lambda c: F.max(F.when(c & (F.col("n") > 0), 1).otherwise(0))
    return pan.groupBy("cluster").agg(has(in_b).alias("b"), has(~in_b).alias("o")).filter("b = 0 AND o = 1").select("cluster")


def occupied(pan: DataFrame, least: int) -> DataFrame:
    """The rows of clusters in at least `least` taxa: the occupancy limit of contrasts and intersections."""
    keep = occupancy(pan).filter(F.col("occ") >= least).select("cluster")
    return pan.join(keep, "cluster", "left_semi").select(*pan.columns)


def taxa_like(pan: DataFrame, pattern: str) -> DataFrame:
    """The rows of taxa whose name matches a regular expression."""
    return pan.filter(F.col("taxon").cast("string").rlike(pattern))


def present_a_absent_b(pan: DataFrame, a: list[str], b: list[str], present: float = 100, absent: float = 100) -> DataFrame:
    """Clusters that at least `present` % of a have and at least `absent` % of b lack."""
    count = lambda taxa: F.count_distinct(F.when(F.col("taxon").isin(taxa) & (F.col("n") > 0), F.col("taxon")))
    g = pan.groupBy("cluster").agg(count(a).alias("a"), count(b).alias("b"))
    return g.filter((100 * F.col("a") >= present * len(a)) & (100 * (len(b) - F.col("b")) >= absent * len(b))).select("cluster")


def expansions(pan: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """Clusters in all of a and b with more copies in each of a than in any of b."""
    pick = lambda taxa: F.when(F.col("taxon").isin(taxa) & (F.col("n") > 0), F.col("n"))
    g = pan.groupBy("cluster").agg(F.count(pick(a)).alias("na"), F.count(pick(b)).alias("nb"), F.min(pick(a)).alias("min_a"), F.max(pick(b)).alias("max_b"))
    return g.filter((F.col("na") == len(a)) & (F.col("nb") == len(b)) & (F.col("min_a") > F.col("max_b"))).select("cluster", "min_a", "max_b")


def _pairs(pan: DataFrame) -> DataFrame:
    x = pan.filter("n > 0")
    return x.select(F.col("taxon").alias("t1"), "cluster", F.col("n").alias("n1")).join(x.select(F.col("taxon").alias("t2"), "cluster", F.col("n").alias("n2")), "cluster").filter("t1 <> t2")


def shared_clusters(pan: DataFrame) -> DataFrame:
    """(t1, t2, shared) for ordered pairs of taxa that share a cluster."""
    return _pairs(pan).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("shared"))


def mean_shared_percent(pan: DataFrame) -> DataFrame:
    """The mean over pairs of shared clusters in percent of the first taxon's clusters."""
    own = pan.filter("n > 0").groupBy(F.col("taxon").alias("t1")).agg(F.count(F.lit(1)).alias("own"))
    return shared_clusters(pan).join(own, "t1").agg(F.avg(100.0 * F.col("shared") / F.col("own")).alias("percent"))


def pocp(pan: DataFrame, totals: DataFrame) -> DataFrame:
    """(t1, t2, pocp) in percent: copies in shared clusters of both over all sequences of both; totals(taxon, total)."""
    t = totals.select("taxon", "total")
    c = _pairs(pan).groupBy("t1", "t2").agg((F.sum("n1") + F.sum("n2")).alias("c"))
    for k in ("t1", "t2"):
        c = c.join(t.select(F.col("taxon").alias(k), F.col("total").alias(f"{k}_total")), k)
    return c.select("t1", "t2", (100.0 * F.col("c") / (F.col("t1_total") + F.col("t2_total"))).alias("pocp"))


def aligned_fraction(members: DataFrame, totals: DataFrame) -> DataFrame:
    """members(cluster, seq_id, taxon, length), totals(taxon, residues) -> (t1, t2, af) in percent, directional.

    A sequence counts once per partner of the other taxon in its cluster.
    """
    x = members.select("cluster", F.col("taxon").alias("t1"), "length")
    partners = members.groupBy("cluster", F.col("taxon").alias("t2")).agg(F.count(F.lit(1)).alias("k"))
    s = x.join(partners, "cluster").filter("t1 <> t2").groupBy("t1", "t2").agg(F.sum(F.col("length") * F.col("k")).alias("aligned"))
    return s.join(totals.select(F.col("taxon").alias("t1"), "residues"), "t1").select("t1", "t2", (100.0 * F.col("aligned") / F.col("residues")).alias("af"))


def mean_identity(pairs: DataFrame) -> DataFrame:
    """pairs(ta, tb, pident) of clustered sequences -> (t1, t2, ani) both ways; a missing cell takes the transposed one."""
    one = pairs.groupBy(F.col("ta").alias("t1"), F.col("tb").alias("t2")).agg(F.avg("pident").alias("ani"))
    back = one.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), F.col("ani").alias("other"))
    return one.join(back, ["t1", "t2"], "full").select("t1", "t2", F.coalesce("ani", "other").alias("ani")).filter("t1 <> t2")


def clustered_identity(clusters: DataFrame, hits: DataFrame) -> DataFrame:
    """(t1, t2, ani) over the hits between sequences of one cluster, each pair once."""
    member = clusters.select("cluster_id", F.col("seq_id").alias("q"), F.col("taxon").alias("ta"))
    other = clusters.select("cluster_id", F.col("seq_id").alias("s"), F.col("taxon").alias("tb"))
    pairs = member.join(other, "cluster_id").filter("q < s").select("q", "s", "ta", "tb").distinct()
    return mean_identity(pairs.join(hits.select("q", "s", "pident"), ["q", "s"]))


def square(cells: DataFrame, taxa: DataFrame, value: str) -> DataFrame:
    """Every pair of taxa: 100 on the diagonal, null where there is no cell. Size: taxa squared, as the matrix has."""
    t = taxa.select("taxon").distinct()
    full = t.select(F.col("taxon").alias("t1")).crossJoin(t.select(F.col("taxon").alias("t2")))
    return full.join(cells, ["t1", "t2"], "left").withColumn(value, F.when(F.col("t1") == F.col("t2"), F.lit(100.0)).otherwise(F.col(value)))


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of two matrices of the same taxa next to each other; cluster names keep apart by their source."""
    return a.select("taxon", F.concat(F.lit("a:"), "cluster").alias("cluster"), "n").unionByName(b.select("taxon", F.concat(F.lit("b:"), "cluster").alias("cluster"), "n"))


def add_growth(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell-wise sum of two growth tables (sample, g, n) with equal samples and genomes."""
    return a.join(b.withColumnRenamed("n", "m"), ["sample", "g"]).select("sample", "g", (F.col("n") + F.col("m")).alias("n"))


def variable_clusters(pan: DataFrame) -> DataFrame:
    """Rows of clusters whose copy number isn't the same in all taxa (absent counts as 0)."""
    g = pan.groupBy("cluster").agg(F.count_distinct("taxon").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    keep = g.crossJoin(F.broadcast(n_taxa(pan))).filter("k < n_taxa OR lo <> hi").select("cluster")
    return pan.join(keep, "cluster", "left_semi")


def drop_redundant(cells: DataFrame, taxa: DataFrame, value: str, cutoff: float) -> DataFrame:
    """Taxa without any off-diagonal value above the cutoff."""
    bad = cells.filter((F.col("t1") != F.col("t2")) & (F.col(value) > cutoff)).select(F.col("t1").alias("taxon")).distinct()
    return taxa.join(bad, "taxon", "left_anti")


def binary_strings(pan: DataFrame) -> DataFrame:
    """(taxon, bits): presence as 0/1 characters over all clusters in order of their names."""
    cells = pan.groupBy("taxon", "cluster").agg(F.max("n").alias("n"))
    return row_texts(cells, "taxon", "cluster", F.when(F.col("n") > 0, "1").otherwise("0"), "0", "", positions(pan, "cluster")).withColumnRenamed("text", "bits")


def distances(pan: DataFrame) -> DataFrame:
    """(t1, t2, manhattan, euclid2, gower) for t1 < t2, absent as 0.

    From per-taxon sums and a join on shared clusters alone: |x - y| = x + y - 2 min(x, y). Gower's distance is the mean
    over all clusters of |x - y| by the cluster's range of copies; clusters without a range add nothing. Its parts are
    taken in whole millionths of a cluster, so that sums don't depend on their order.
    """
    x = pan.filter("n > 0")
    taxa_n = x.agg(F.count_distinct("taxon").alias("all_taxa"))
    ranges = x.groupBy("cluster").agg((F.max("n") - F.min("n")).alias("seen"), F.max("n").alias("hi"), F.count_distinct("taxon").alias("occ")).crossJoin(F.broadcast(taxa_n))
    ranges = ranges.select("cluster", F.when(F.col("occ") < F.col("all_taxa"), F.col("hi")).otherwise(F.col("seen")).alias("span"))
    x = x.join(ranges, "cluster").withColumn("g", F.when(F.col("span") > 0, F.round(1e6 * F.col("n") / F.col("span"))).otherwise(0).cast("long"))
    n_clusters = ranges.agg(F.count(F.lit(1)).alias("n_clusters"))
    one = x.groupBy("taxon").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum("g").alias("gs"))
    left, right = (x.select(F.col("taxon").alias(f"t{i}"), "cluster", F.col("n").alias(f"n{i}"), F.col("g").alias(f"g{i}")) for i in (1, 2))
    both = left.join(right, "cluster").filter("t1 < t2")
    shared = both.groupBy("t1", "t2").agg(F.sum(F.least("n1", "n2")).alias("m"), F.sum(F.col("n1") * F.col("n2")).alias("d"), F.sum(F.least("g1", "g2")).alias("gm"))
    taxa = one.select("taxon")
    every = taxa.select(F.col("taxon").alias("t1")).crossJoin(taxa.select(F.col("taxon").alias("t2"))).filter("t1 < t2")
    out = every.join(shared, ["t1", "t2"], "left").fillna(0, ["m", "d", "gm"])
    for k in ("t1", "t2"):
        out = out.join(one.select(F.col("taxon").alias(k), F.col("s").alias(f"s_{k}"), F.col("q").alias(f"q_{k}"), F.col("gs").alias(f"gs_{k}")), k)
    gower = (F.col("gs_t1") + F.col("gs_t2") - 2 * F.col("gm")) / 1e6 / F.col("n_clusters")
    return out.crossJoin(F.broadcast(n_clusters)).select("t1", "t2", (F.col("s_t1") + F.col("s_t2") - 2 * F.col("m")).alias("manhattan"), (F.col("q_t1") + F.col("q_t2") - 2 * F.col("d")).alias("euclid2"), gower.alias("gower"))


def match_reference(pairs: DataFrame, sizes: DataFrame, identity: float, coverage: float, best_only: bool = False) -> DataFrame:
    """pairs(cluster, ref, pident, cover), sizes(ref, size): the references that each cluster matches, with their sizes."""
    ok = pairs.filter((F.col("pident") >= identity) & (F.col("cover") >= coverage))
    if best_only:
        ok = ok.withColumn("_n", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("pident"), F.desc("cover"), "ref"))).filter("_n = 1")
    return ok.join(sizes, "ref").groupBy("cluster").agg(F.sum("size").alias("n"), F.array_join(F.sort_array(F.collect_list("ref")), ",").alias("refs"))


def median_length(members: DataFrame, lower: bool = False) -> DataFrame:
    """(cluster, median, rep): the upper (or lower) median of the lengths and the first sequence that has it."""
    g = members.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("length", "seq_id"))).alias("m"))
    med = F.get(F.transform("m", lambda x: x["length"]), F.floor((F.size("m") - (1 if lower else 0)) / 2).cast("int"))
    g = g.withColumn("median", med)
    return g.select("cluster", "median", F.array_min(F.transform(F.filter("m", lambda x: x["length"] == F.col("median")), lambda x: x["seq_id"])).alias("rep"))


def totals(seqs: DataFrame, redundant: DataFrame | None = None) -> DataFrame:
    """(taxon, total, residues) of a set of sequences, without redundant ones if they are given."""
    kept = seqs.join(redundant.select("seq_id"), "seq_id", "left_anti") if redundant is not None else seqs
    return kept.groupBy("taxon").agg(F.count(F.lit(1)).alias("total"), F.sum(F.length("seq")).cast("long").alias("residues"))

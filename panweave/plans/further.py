"""Queries of the remaining operators: rescue and domain rules, redundancy, synteny, growth, containment, fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.functions import models
from panweave.functions import sequences as S
from panweave.operators import clusters as C
from panweave.operators import graph as G
from panweave.operators import growth as GR
from panweave.operators import homology as H
from panweave.operators import matrix as M
from panweave.operators import msa as A
from panweave.operators import sequences as Q
from panweave.operators import stats as ST
from panweave.plans import pipelines as P
from panweave.plans import registry as R
from panweave.plans import views as V
from panweave.plans.registry import query
from panweave.streaming import incremental
from panweave.tables import Tables

_C = V.ORDER_CLUSTERS_SQL


# --- hits -------------------------------------------------------------------------------------------------------------

@query(f"""WITH {V.HITS_SQL} SELECT q, s, row_number() OVER (PARTITION BY q ORDER BY evalue, ts <> tq, s) AS rk FROM hits""")
def hits_own_taxon_first(spark, d):
    return H.ranked(V.hits(spark, d).drop("rk"), own_first=True).select("q", "s", F.col("rk").cast("long").alias("rk"))


@query(f"""WITH {V.HITS_SQL}, p AS (SELECT p_partkey AS i, p_type AS dom FROM part), t AS MATERIALIZED (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY q, ts ORDER BY evalue) AS r FROM hits WHERE tq <> ts) WHERE r = 1),
  u AS MATERIALIZED (SELECT t.* FROM t JOIN p x ON x.i = q JOIN p y ON y.i = s WHERE x.dom = y.dom), back AS (SELECT s AS q, q AS s, qcov AS bq, scov AS bs, evalue AS be FROM u)
  SELECT q, s FROM u LEFT JOIN back USING (q, s) WHERE pident >= 55 AND (least(qcov, scov) >= 70 OR coalesce(least(bq, bs) >= 70, false)) AND (evalue <= 0.001 OR coalesce(be <= 0.001, false))""")
def rescued_best_hits(spark, d):
    """Equal domains at both ends; poor coverage or E-value is made up for by the reverse hit."""
    domains = V.table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_type").alias("domains"))
    cfg = R.Config(evalue=0.001, identity=55, coverage=70)
    ties = Tables(spark, "ties").save(H.top_ties(V.hits(spark, d)))
    return H.best(ties, cfg, domains=domains, rescue=True).select("q", "s")


@query(f"""WITH {V.HITS_SQL}, seed AS (SELECT p_partkey AS i, p_partkey - p_partkey % 4 AS seed FROM part WHERE p_partkey % 4 > 0)
  SELECT coalesce(x.seed, q) AS q, coalesce(y.seed, s) AS s, bits::BIGINT AS bits FROM hits LEFT JOIN seed x ON x.i = q LEFT JOIN seed y ON y.i = s""")
def hits_between_seeds(spark, d):
    seeds = V.table(spark, d, "part").filter("p_partkey % 4 > 0").select(F.col("p_partkey").alias("seq_id"), (F.col("p_partkey") - F.col("p_partkey") % 4).alias("seed"))
    return H.collapse_to_seeds(V.hits(spark, d), seeds).select("q", "s", F.col("bits").cast("long").alias("bits"))


_SPAN_SQL = """sp AS (SELECT q, s, tq, ts, CASE WHEN bits % 3 = 0 THEN 100.0 ELSE pident END AS pident, (1 + bits::BIGINT % 2)::INT AS qs, (1 + (bits::BIGINT % 5) // 4)::INT AS ss, (90 + q % 10)::INT AS qe, (90 + s % 10)::INT AS se, (q % 20 + 85)::INT AS qlen, (s % 20 + 85)::INT AS slen, 1 AS n_segments FROM hits)"""


def _spans(spark, d):
    x = lambda e, n: F.expr(e).cast("int").alias(n)
    return V.hits(spark, d).select("q", "s", "tq", "ts", F.when(F.expr("bits % 3 = 0"), 100.0).otherwise(F.col("pident")).alias("pident"), x("1 + bits % 2", "qs"), x("1 + floor(bits % 5 / 4)", "ss"), x("90 + q % 10", "qe"), x("90 + s % 10", "se"),
                                   x("q % 20 + 85", "qlen"), x("s % 20 + 85", "slen"), F.lit(1).alias("n_segments"))


_ISOFORM_SQL = """iso AS (SELECT q, s, tq FROM sp WHERE q < s AND tq = ts AND pident = 100 AND least(qe - qs, se - ss) + 1 >= 40
  AND (((qs = 1 OR ss = 1) AND (qe = qlen OR se = slen)) OR 100 * (least(qe - qs, se - ss) + 1) >= 99 * least(qlen, slen)))"""


@query(f"WITH {V.HITS_SQL}, {_SPAN_SQL}, {_ISOFORM_SQL} SELECT q, s FROM iso")
def isoform_pairs(spark, d):
    return H.isoform_pairs(_spans(spark, d), R.CFG).select("q", "s")


@query(f"""WITH RECURSIVE {V.HITS_SQL}, {_SPAN_SQL}, {_ISOFORM_SQL}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tq ORDER BY q, s) AS i FROM iso),
  f AS (SELECT tq, 0 AS i, []::BIGINT[] AS gone, []::BIGINT[] AS rep FROM (SELECT DISTINCT tq FROM n) UNION ALL
    SELECT f.tq, n.i, CASE WHEN list_contains(gone, n.q) OR list_contains(gone, n.s) THEN gone ELSE list_append(gone, n.s) END, CASE WHEN list_contains(gone, n.q) OR list_contains(gone, n.s) THEN rep ELSE list_append(rep, n.q) END FROM f JOIN n ON n.tq = f.tq AND n.i = f.i + 1)
  SELECT unnest(gone) AS seq_id, unnest(rep) AS rep_id FROM (SELECT *, max(i) OVER (PARTITION BY tq) AS top FROM f) WHERE i = top""")
def absorbed_isoforms(spark, d):
    return G.greedy_absorb(H.isoform_pairs(_spans(spark, d), R.CFG), "tq")


@query(f"WITH {V.HITS_SQL} SELECT q, s, bits::BIGINT AS bits FROM hits WHERE q % 7 <> 0 AND s % 7 <> 0")
def hits_without_redundant(spark, d):
    redundant = V.table(spark, d, "part").filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("seq_id"))
    return Q.without_redundant(V.hits(spark, d), redundant).select("q", "s", F.col("bits").cast("long").alias("bits"))


@query("WITH t AS (SELECT DISTINCT p_brand AS t FROM part) SELECT a.t AS ta, b.t AS tb FROM t a, t b WHERE a.t = 'Brand#13' OR b.t = 'Brand#13' OR a.t = b.t")
def minimal_pairs(spark, d):
    t = V.table(spark, d, "part").select("p_brand").distinct()
    return incremental.minimal_pairs(t.select(F.col("p_brand").alias("ta")).crossJoin(t.select(F.col("p_brand").alias("tb"))), "Brand#13")


@query(f"WITH {V.HITS_SQL} SELECT q, s FROM hits WHERE NOT (substr(tq, 7, 1) = '1' AND substr(ts, 7, 1) = '2')")
def hits_of_new_pairs(spark, d):
    """Hits of pairs of taxa that no stored result has yet."""
    t = V.table(spark, d, "part").select("p_brand").distinct()
    stored = t.filter("substr(p_brand, 7, 1) = '1'").select(F.col("p_brand").alias("ta")).crossJoin(t.filter("substr(p_brand, 7, 1) = '2'").select(F.col("p_brand").alias("tb")))
    return incremental.new_pairs(V.hits(spark, d), stored).select("q", "s")


@query(f"""WITH {V.HITS_SQL}, ok AS (SELECT q AS cluster, s AS ref, pident, qcov AS cover FROM hits WHERE pident >= 80 AND qcov >= 60)
  SELECT cluster, sum(p_size)::BIGINT AS n, string_agg('r' || ref, ',' ORDER BY 'r' || ref) AS refs FROM ok JOIN part ON p_partkey = ref GROUP BY cluster""")
def clusters_matching_a_reference(spark, d):
    pairs = V.hits(spark, d).select(F.col("q").alias("cluster"), F.concat(F.lit("r"), "s").alias("ref"), "pident", F.col("qcov").alias("cover"))
    sizes = V.table(spark, d, "part").select(F.concat(F.lit("r"), "p_partkey").alias("ref"), F.col("p_size").cast("long").alias("size"))
    return M.match_reference(pairs, sizes, 80, 60)


@query(f"""WITH {V.HITS_SQL}, {_C}, p AS (SELECT DISTINCT a.seq_id AS q, b.seq_id AS s, a.taxon AS ta, b.taxon AS tb FROM clusters a JOIN clusters b USING (cluster_id) WHERE a.seq_id < b.seq_id),
  o AS (SELECT ta, tb, avg(pident) AS ani FROM p JOIN hits USING (q, s) GROUP BY ALL)
  SELECT coalesce(x.ta, y.tb) AS t1, coalesce(x.tb, y.ta) AS t2, round(coalesce(x.ani, y.ani), 6) AS ani FROM o x FULL JOIN o y ON x.ta = y.tb AND x.tb = y.ta WHERE coalesce(x.ta, y.tb) <> coalesce(x.tb, y.ta)""")
def identity_of_clustered_pairs(spark, d):
    return M.clustered_identity(V.order_clusters(spark, d), V.hits(spark, d)).withColumn("ani", F.round("ani", 6))


# --- clusters ---------------------------------------------------------------------------------------------------------

@query("""WITH RECURSIVE p AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, l_orderkey || '-' || l_partkey % 5 AS a, l_orderkey || '-' || l_suppkey % 5 AS b FROM lineitem),
  f AS (SELECT DISTINCT o, 0::BIGINT AS i, []::VARCHAR[] AS m, []::VARCHAR[] AS h FROM p UNION ALL
    SELECT o, i, CASE WHEN list_contains(m1, b) THEN m1 ELSE list_append(m1, b) END, CASE WHEN list_contains(m1, b) THEN h1 ELSE list_append(h1, h1[list_position(m1, a)]) END FROM (
      SELECT p.o, p.i, a, b, CASE WHEN list_contains(m, a) THEN m ELSE list_append(m, a) END AS m1, CASE WHEN list_contains(m, a) THEN h WHEN list_contains(m, b) THEN list_append(h, h[list_position(m, b)]) ELSE list_append(h, a) END AS h1
      FROM f JOIN p ON p.o = f.o AND p.i = f.i + 1))
  SELECT unnest(h) AS cluster_id, unnest(m) AS member FROM (SELECT *, max(i) OVER (PARTITION BY o) AS top FROM f) WHERE i = top""")
def pairs_in_file_order(spark, d):
    """A pair joins its second gene to the first one's cluster, in the order of the pairs."""
    li = V.table(spark, d, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    name = lambda c: F.concat_ws("-", "l_orderkey", F.col(c) % 5)
    pairs = li.select(F.row_number().over(w).alias("ord"), name("l_partkey").alias("a"), name("l_suppkey").alias("b"))
    tables = Tables(spark, "order")
    return P.pairs_to_clusters(tables, tables.save(pairs))


@query("""WITH g AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS l FROM lineitem), x AS (SELECT o * 10 + l AS i, o // 4 * 10 + l AS c, CASE WHEN (o * 7 + l) % 3 = 0 THEN -1 ELSE 1 END AS s, o, l FROM g),
  s AS (SELECT a.i AS seg, a.c AS lc, b.c AS rc, a.s AS ls, b.s AS rs FROM x a JOIN x b ON b.o = a.o AND b.l = a.l + 1), t AS (SELECT seg, least(lc, rc) AS c1, greatest(lc, rc) AS c2, ls AS s1, rs AS s2 FROM s),
  k AS (SELECT c, count(*) AS size FROM x GROUP BY c), z AS (SELECT c1, c2, s1, s2, count(*) AS n, string_agg(seg, ',' ORDER BY seg) AS segments FROM t GROUP BY ALL)
  SELECT c1, c2, segments FROM z JOIN k ON k.c = c1 WHERE n = size""")
def clusters_of_intergenic_segments(spark, d):
    g = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l")).distinct()
    x = g.select((F.col("o") * 10 + F.col("l")).alias("seq_id"), (F.floor(F.col("o") / 4) * 10 + F.col("l")).alias("cluster_id"), F.when((F.col("o") * 7 + F.col("l")) % 3 == 0, -1).otherwise(1).alias("strand"))
    right = x.select((F.col("seq_id") - 1).alias("seq_id"), F.col("seq_id").alias("right_gene"), F.col("strand").alias("right_strand"))
    segments = x.join(right, "seq_id").select(F.col("seq_id").alias("seg_id"), F.lit("t").alias("taxon"), F.col("seq_id").alias("left_gene"), "right_gene", F.col("strand").alias("left_strand"), "right_strand")
    found = C.intergenic_clusters(segments, x)
    return found.select("c1", "c2", F.array_join(F.transform("segments", lambda v: v.cast("string")), ",").alias("segments"))


@query("""WITH c AS (SELECT p_partkey - p_partkey % 5 AS c, p_partkey AS i FROM part WHERE p_partkey % 5 < 3), e AS (SELECT p_partkey AS i, p_partkey - (CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 4 END) AS seed FROM part WHERE p_partkey % 5 = 4)
  SELECT c AS cluster_id, i AS seq_id FROM c UNION ALL SELECT coalesce(c.c, e.seed), e.i FROM e LEFT JOIN c ON c.i = e.seed UNION ALL SELECT DISTINCT e.seed, e.seed FROM e LEFT JOIN c ON c.i = e.seed WHERE c.c IS NULL""")
def clusters_with_expansions(spark, d):
    """Copies of one lineage join the cluster of their seed, or make one where the seed is in none."""
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("i"))
    clusters = p.filter("i % 5 < 3").select((F.col("i") - F.col("i") % 5).alias("cluster_id"), F.col("i").alias("seq_id"))
    copies = p.filter("i % 5 = 4").select(F.col("i").alias("seq_id"), (F.col("i") - F.when(F.col("i") % 7 == 0, 1).otherwise(4)).alias("seed"))
    return G.merge_expansions(clusters, copies)


@query("SELECT DISTINCT o_orderkey % 7 || '_' || o_orderpriority AS name, o_orderkey % 7 AS number FROM orders UNION ALL SELECT DISTINCT o_orderstatus, NULL FROM orders")
def leading_numbers(spark, d):
    o = V.table(spark, d, "orders")
    names = o.select(F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit("_"), "o_orderpriority").alias("name")).distinct().unionByName(o.select(F.col("o_orderstatus").alias("name")).distinct())
    return C.by_leading_number(names).withColumn("number", C.leading_number(F.col("name")))


_NR_SQL = f"""{V.PAN_SQL}, {V.HITS_SQL}, len AS (SELECT p_partkey AS cluster, p_size AS length FROM part),
  d AS MATERIALIZED (SELECT DISTINCT s AS keep, q AS gone FROM hits JOIN len a ON a.cluster = q JOIN len b ON b.cluster = s
    WHERE (a.length < b.length OR (a.length = b.length AND q > s)) AND pident >= 95 AND CASE WHEN a.length > b.length THEN qcov ELSE scov END >= 90),
  st AS (SELECT cluster FROM len WHERE cluster NOT IN (SELECT gone FROM d))"""


def _nr(spark, d):
    lengths = V.table(spark, d, "part").select(F.col("p_partkey").alias("cluster"), F.col("p_size").alias("length"))
    return P.nonredundant(Tables(spark, "nr"), V.pangenome(spark, d), lengths, V.hits(spark, d).select("q", "s", "pident", "qcov", "scov"), 95, 90)


@query(f"""WITH {_NR_SQL}, a AS (SELECT taxon, cluster, n FROM pan UNION ALL SELECT taxon, keep, n FROM pan JOIN d ON gone = cluster) SELECT taxon, cluster, sum(n)::BIGINT AS n FROM a SEMI JOIN st USING (cluster) GROUP BY ALL""")
def nonredundant_matrix(spark, d):
    return _nr(spark, d)[0]


@query(f"""WITH RECURSIVE {_NR_SQL}, r AS (SELECT keep AS root, gone FROM d WHERE keep IN (SELECT cluster FROM st) UNION SELECT r.root, d.gone FROM r JOIN d ON d.keep = r.gone)
  SELECT cluster, cluster || coalesce('+' || count(gone), '') AS name, coalesce(string_agg(gone, ',' ORDER BY gone), '') AS members FROM (SELECT st.cluster, r.gone FROM st JOIN r ON r.root = st.cluster) GROUP BY cluster
  UNION ALL SELECT cluster, cluster::VARCHAR, '' FROM st WHERE cluster NOT IN (SELECT root FROM r)""")
def nonredundant_names(spark, d):
    """Kept clusters with the number and the list of all that hang on them, over all levels."""
    return _nr(spark, d)[1].select("cluster", "name", F.array_join(F.transform("members", lambda v: v.cast("string")), ",").alias("members"))


@query("""WITH m AS (SELECT l_orderkey AS cluster, l_partkey AS seq_id, l_quantity::BIGINT AS length FROM lineitem), s AS (SELECT cluster, list(length ORDER BY length, seq_id) AS l, list(seq_id ORDER BY length, seq_id) AS i FROM m GROUP BY ALL)
  SELECT cluster, l[1 + (len(l) - 1) // 2] AS median, list_min(list_filter(i, lambda x, k: l[k] = l[1 + (len(l) - 1) // 2])) AS rep FROM s""")
def lower_median_representative(spark, d):
    m = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.col("l_partkey").alias("seq_id"), F.col("l_quantity").cast("long").alias("length"))
    return M.median_length(m, lower=True)


# --- the matrix -------------------------------------------------------------------------------------------------------

@query(f"""WITH {V.PAN_SQL}, o AS (SELECT cluster FROM pan GROUP BY ALL HAVING count(*) >= 6) SELECT cluster FROM pan SEMI JOIN o USING (cluster) GROUP BY ALL
  HAVING count(*) FILTER (taxon IN (1, 2, 3)) >= 2 AND count(*) FILTER (taxon IN (4, 5, 6)) <= 1""")
def contrast_above_an_occupancy(spark, d):
    return M.present_a_absent_b(M.occupied(V.pangenome(spark, d), 6), R.GROUP_A, R.GROUP_B, present=60, absent=60)


@query(f"WITH {V.PAN_SQL} SELECT * FROM pan WHERE regexp_matches(taxon::VARCHAR, '^1[0-2]?$')")
def taxa_by_pattern(spark, d):
    return M.taxa_like(V.pangenome(spark, d), "^1[0-2]?$")


@query("""WITH m AS (SELECT p_partkey AS i, p_brand AS taxon, p_partkey // 6 AS cluster FROM part WHERE p_partkey % 9 <> 0), pan AS (SELECT taxon, cluster, count(*) AS n FROM m GROUP BY ALL), t AS (SELECT taxon, count(*) AS total FROM m GROUP BY ALL)
  SELECT a.taxon AS t1, b.taxon AS t2, round(100.0::DOUBLE * sum(a.n + b.n)::BIGINT / any_value(x.total + y.total)::BIGINT, 6) AS pocp FROM pan a JOIN pan b USING (cluster) JOIN t x ON x.taxon = a.taxon JOIN t y ON y.taxon = b.taxon WHERE a.taxon <> b.taxon GROUP BY ALL""")
def pocp_without_isoforms(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_brand").alias("taxon"), F.floor(F.col("p_partkey") / 6).alias("cluster"), F.lit("M").alias("seq"))
    redundant = p.filter("seq_id % 9 = 0").select("seq_id")
    pan = p.join(redundant, "seq_id", "left_anti").groupBy("taxon", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return M.pocp(pan, M.totals(p, redundant)).withColumn("pocp", F.round("pocp", 6))


@query("SELECT p_brand AS domain, coalesce(sum(p_size) FILTER (p_partkey % 2 = 0), 0)::BIGINT AS x, coalesce(sum(p_size) FILTER (p_partkey % 2 = 1), 0)::BIGINT AS y FROM part GROUP BY ALL")
def merged_tools(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_brand").alias("domain"), F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("y").alias("tool"), F.col("p_size").cast("long").alias("n"))
    return ST.merge_tools(p, ["x", "y"])


@query("""SELECT taxon, round(0.5::DOUBLE * log2(residues * residues / (n * 0.01::DOUBLE)), 6) AS bits FROM (SELECT lang AS taxon, count(*)::DOUBLE AS n, sum(length(text))::DOUBLE AS residues FROM documents WHERE text IS NOT NULL GROUP BY ALL)""")
def least_search_bits(spark, d):
    r = Q.taxon_ranges(V.sequences(spark, d))
    return r.select("taxon", F.round(S.min_bits(F.col("residues").cast("double"), F.col("n").cast("double")), 6).alias("bits"))


@query("""SELECT doc_id AS seq_id, row_number() OVER (ORDER BY length(text) DESC, md5(doc_id::VARCHAR)) AS place FROM documents WHERE length(text) BETWEEN 20 AND 25000""")
def longest_first(spark, d):
    return Q.by_length(V.sequences(spark, d)).select("seq_id", "place")


@query(f"SELECT domain, exp, ctrl FROM ({R.ORACLES['set_enrichment_fisher']}) WHERE q <= 0.9")
def enriched_domains(spark, d):
    """Only domains at or below the cutoff of the adjusted p."""
    return ST.enrichment(R._enrichment(spark, d), cutoff=0.9).select("domain", "exp", "ctrl")


# --- growth -----------------------------------------------------------------------------------------------------------

_BRANDS_SQL = "ord AS (SELECT s AS sample, taxon, row_number() OVER (PARTITION BY s ORDER BY md5(s || '|' || taxon)) - 1 AS g FROM (SELECT DISTINCT p_brand AS taxon FROM part), unnest(range(0, 5)) AS u(s))"


def _brands(spark, d):
    return R._orders(V.table(spark, d, "part").select(F.col("p_brand").alias("taxon")))


def _quads(spark, d):
    """Parts in clusters of twelve successive numbers, by brand."""
    return V.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 12).alias("cluster_id"), F.col("p_partkey").alias("seq_id"), F.col("p_brand").alias("taxon"))


@query(f"""WITH {_BRANDS_SQL}, m AS (SELECT p_partkey // 12 AS c, p_partkey AS i, p_brand AS taxon FROM part), x AS (SELECT i FROM (SELECT *, min(i) OVER (PARTITION BY c, taxon) AS f FROM m) WHERE i <> f)
  SELECT sample, count(i) AS core, count(i) AS pan FROM ord LEFT JOIN (SELECT * FROM m ANTI JOIN x USING (i)) USING (taxon) WHERE g = 0 GROUP BY sample""")
def growth_start(spark, d):
    quads = _quads(spark, d)
    return GR.initial_size(quads.select("seq_id", "taxon"), GR.later_copies(quads), _brands(spark, d)).select(F.col("sample").cast("long").alias("sample"), "core", "pan")


@query("""WITH m AS (SELECT p_partkey // 12 AS c, p_partkey AS i, p_brand AS taxon FROM part) SELECT i AS seq_id FROM (SELECT *, count(*) OVER (PARTITION BY c, taxon) AS k, min(i) OVER (PARTITION BY c) AS f FROM m) WHERE k > 1 AND i <> f""")
def extra_copies(spark, d):
    return GR.extra_copies(_quads(spark, d))


@query(f"""WITH {R._BEST_SQL}, o AS ({R._RECIPROCAL.format('best')}), {_BRANDS_SQL}, x AS (SELECT a AS i, ta AS taxon, tb AS other FROM o UNION SELECT b, tb, ta FROM o),
  s AS (SELECT x.i, o2.sample, o2.g, row_number() OVER (PARTITION BY o2.sample, x.i ORDER BY o2.g) AS k FROM x JOIN ord o1 ON o1.taxon = x.taxon AND o1.g = 0 JOIN ord o2 ON o2.sample = o1.sample AND o2.taxon = x.other)
  SELECT ord.sample, ord.g, count(s.i) AS core FROM ord LEFT JOIN s ON s.sample = ord.sample AND s.g = ord.g AND s.k = s.g WHERE ord.g > 0 GROUP BY ALL""")
def best_hit_core_growth(spark, d):
    """Core growth from reciprocal best hits to the first taxon of each order."""
    pairs = Tables(spark, "star").save(H.reciprocal(Tables(spark, "best").save(H.best(V.hits(spark, d), R.CFG)), R.CFG))
    both = pairs.select(F.col("a").alias("seq_id"), F.col("ta").alias("taxon"), F.col("tb").alias("other")).unionByName(pairs.select(F.col("b").alias("seq_id"), F.col("tb").alias("taxon"), F.col("ta").alias("other")))
    return GR.star_core(both, _brands(spark, d)).select(F.col("sample").cast("long").alias("sample"), F.col("g").cast("long").alias("g"), "core")


@query(f"""WITH {V.HITS_SQL}, {_BRANDS_SQL}, m AS (SELECT p_partkey // 12 AS c, p_partkey AS i, p_brand AS taxon FROM part), e AS (SELECT i FROM (SELECT *, count(*) OVER (PARTITION BY c, taxon) AS k, min(i) OVER (PARTITION BY c) AS f FROM m) WHERE k > 1 AND i <> f),
  h AS (SELECT DISTINCT q, ts FROM hits WHERE tq <> ts AND evalue <= 0.01 AND pident >= 0 AND least(qcov, scov) >= 40), n AS (SELECT i, taxon FROM m WHERE i % 11 <> 0 AND i % 17 <> 0 AND i NOT IN (SELECT i FROM e)),
  f AS (SELECT q, sample, min(g) AS f FROM h JOIN ord ON ord.taxon = ts GROUP BY ALL)
  SELECT o.sample, o.g, count(*) AS new FROM n JOIN ord o USING (taxon) LEFT JOIN f ON f.q = n.i AND f.sample = o.sample WHERE f.f IS NULL OR f.f >= o.g GROUP BY ALL""")
def transcript_increments(spark, d):
    """New genes of each added taxon without redundant sequences, cloud genes and extra copies."""
    quads = _quads(spark, d)
    gone = quads.filter("seq_id % 11 = 0 OR seq_id % 17 = 0").select("seq_id")
    genes = quads.select("seq_id", "taxon").join(gone, "seq_id", "left_anti")
    homologs = H.homologs(V.hits(spark, d), R.CFG).select("q", "ts")
    return GR.pan_increments(genes, homologs, GR.extra_copies(quads), _brands(spark, d)).select(F.col("sample").cast("long").alias("sample"), F.col("g").cast("long").alias("g"), "new")


def _curve(spark, d):
    """The growth table: samples times taxa rows, whatever the pangenome's size."""
    return R.pan_core_growth(spark, d).toPandas()


@query()
def growth_fits(spark, d):
    """Parameters of both core fits and of the pan fit."""
    t = _curve(spark, d)
    fits = {"core": models.fit_core(t["g"] + 1, t["core"]), "core_2": models.fit_core(t["g"] + 1, t["core"], willenbrock=True), "pan": models.fit_pan(t["g"] + 1, t["pan"])}
    return spark.createDataFrame([(k, name, float(v)) for k, f in fits.items() for name, v in f.items()], "fit string, parameter string, value double")


@query()
def occupancy_mixture(spark, d):
    """Binomial mixtures of two to ten components (or as many as taxa) over the occupancy histogram (one row a taxon); the
    one of the least BIC is chosen."""
    hist = [r["n"] for r in M.occupancy_histogram(V.pangenome(spark, d)).orderBy("occ").collect()]
    fits = models.binomial_mixtures(hist)
    rows = [(f["components"], name, float(v)) for f in fits for name, v in f.items()]
    return spark.createDataFrame(rows, "components int, parameter string, value double")


# --- alignments -------------------------------------------------------------------------------------------------------

_SIX_SQL = """msa AS (SELECT vec_id // 6 AS aln, (vec_id % 6)::VARCHAR AS name, array_to_string(list_transform(embedding, lambda v: CASE WHEN abs(v::DOUBLE) < 0.005 THEN '-' WHEN v::DOUBLE < -0.1 THEN 'A' WHEN v::DOUBLE < 0 THEN 'C' WHEN v::DOUBLE < 0.1 THEN 'G' ELSE 'T' END), '') AS seq FROM embeddings)"""


def _sixes(spark, d):
    return V.alignment(spark, d).select(F.floor(F.col("name") / 6).alias("aln"), (F.col("name") % 6).cast("string").alias("name"), "seq")


@query(f"""WITH {_SIX_SQL}, ch AS (SELECT aln, name, pos, substr(seq, pos, 1) AS ch FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS pos FROM msa)),
  g AS (SELECT aln, pos, list(DISTINCT ch) FILTER (name IN ('0', '1', '2')) AS a, list(DISTINCT ch) FILTER (name IN ('3', '4', '5')) AS b FROM ch GROUP BY ALL)
  SELECT aln, pos, a[1] AS in_a, b[1] AS in_b FROM g WHERE len(a) = 1 AND len(b) = 1 AND a[1] <> b[1] AND a[1] <> '-' AND b[1] <> '-'""")
def private_variants(spark, d):
    return A.private_variants(_sixes(spark, d), ["0", "1", "2"], ["3", "4", "5"])


@query()
def collapsed_fragments(spark, d):
    """Fragments of one taxon in one alignment, joined where they overlap: halves of each sequence come together again."""
    m = _sixes(spark, d)
    half = lambda a, b: F.concat(F.repeat(F.lit("-"), F.lit(a)), F.substring("seq", a + 1, b - a), F.repeat(F.lit("-"), F.length("seq") - b))
    parts = m.select("aln", F.col("name").alias("taxon"), F.explode(F.array(F.struct(F.lit("1").alias("name"), half(0, 54).alias("seq")), F.struct(F.lit("2").alias("name"), half(10, 64).alias("seq")))).alias("x")).select("aln", "taxon", "x.name", "x.seq")
    return A.collapse_fragments(parts)


# --- trees ------------------------------------------------------------------------------------------------------------

def _taxa_matrix(spark, d):
    """Names and Manhattan distances of the taxa: taxa squared numbers, whatever the pangenome's size."""
    cells = M.distances(V.pangenome(spark, d)).select("t1", "t2", "manhattan").collect()
    names = sorted({r["t1"] for r in cells} | {r["t2"] for r in cells})
    out = np.zeros((len(names), len(names)))
    for r in cells:
        i, j = names.index(r["t1"]), names.index(r["t2"])
        out[i, j] = out[j, i] = r["manhattan"]
    return names, out


@query()
def taxon_trees(spark, d):
    """Newick trees of the taxa by their distances: linkage trees and neighbour joining, and the silhouette's best cut."""
    names, distance = _taxa_matrix(spark, d)
    label = [str(n) for n in names]
    rows = [(m, models.linkage(label, distance, m)) for m in ("average", "complete", "single", "ward")] + [("bionj", models.bionj(label, distance))]
    width = {k: models.silhouette(distance, models.cut_tree(distance, k)) for k in range(2, len(names))}
    rows.append(("silhouette", ",".join(map(str, models.cut_tree(distance, max(width, key=width.get))))))
    return spark.createDataFrame(rows, "method string, value string")


@query()
def gap_statistic(spark, d):
    """Gap statistic of the taxa, as points of all their principal coordinates."""
    _, distance = _taxa_matrix(spark, d)
    n = len(distance)
    centre = np.eye(n) - 1 / n
    value, vector = np.linalg.eigh(-centre @ distance**2 @ centre / 2)
    real = value > 1e-9 * max(value.max(), 1e-300)
    points = vector[:, real] * np.sqrt(value[real])
    return spark.createDataFrame(models.gap_statistic(points, min(8, n - 1)), "k int, gap double, error double")

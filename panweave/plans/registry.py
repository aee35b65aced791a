"""All queries of the comparative-genomics operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.config import Config
from panweave.functions import sequences as S
from panweave.operators import clusters as C
from panweave.operators import graph as G
from panweave.operators import growth as GR
from panweave.operators import homology as H
from panweave.operators import intervals as I
from panweave.operators import matrix as M
from panweave.operators import msa as A
from panweave.operators import sequences as Q
from panweave.operators import stats as ST
from panweave.plans import views as V
from panweave.tables import Tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Thresholds of the planned queries on the driver's tables, whose E-values are 1 / score.
CFG = Config(evalue=0.01, identity=60, coverage=45, homology_coverage=40)
CODON_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.CODONS.items()) + "}"
GROUP_A, GROUP_B = [1, 2, 3], [4, 5, 6]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


# --- the pangenome matrix ---------------------------------------------------------------------------------------------

@query(f"WITH {V.PAN_SQL} SELECT * FROM pan")
def cluster_copy_number(spark, d):
    return V.pangenome(spark, d)


@query(f"WITH {V.OCC_SQL} SELECT * FROM hist")
def occupancy_histogram(spark, d):
    return M.occupancy_histogram(V.pangenome(spark, d))


@query(f"WITH {V.OCC_SQL} SELECT * FROM comp")
def pangenome_compartments(spark, d):
    return M.compartments(V.pangenome(spark, d))


@query(f"""WITH {V.OCC_SQL} SELECT taxon, count(*) FILTER (compartment = 'cloud') AS cloud, count(*) FILTER (compartment = 'shell') AS shell,
  count(*) FILTER (compartment = 'softcore') AS softcore, count(*) FILTER (core) AS core FROM pan JOIN comp USING (cluster) GROUP BY taxon""")
def taxon_occupancy_stats(spark, d):
    return M.taxon_occupancy(V.pangenome(spark, d))


@query(f"WITH {V.PAN_SQL} SELECT cluster FROM pan GROUP BY ALL HAVING count(*) FILTER (taxon IN (4, 5, 6)) = 0")
def absent_in_b(spark, d):
    return M.absent_in_b(V.pangenome(spark, d), GROUP_B)


@query(f"WITH {V.PAN_SQL} SELECT cluster FROM pan GROUP BY ALL HAVING count(*) FILTER (taxon IN (1, 2, 3)) >= 2 AND count(*) FILTER (taxon IN (4, 5, 6)) <= 1")
def present_a_absent_b(spark, d):
    return M.present_a_absent_b(V.pangenome(spark, d), GROUP_A, GROUP_B, present=60, absent=60)


@query(f"""WITH {V.PAN_SQL} SELECT cluster, min(n) FILTER (taxon IN (1, 2, 3)) AS min_a, max(n) FILTER (taxon IN (4, 5, 6)) AS max_b FROM pan GROUP BY ALL
  HAVING count(*) FILTER (taxon IN (1, 2, 3)) = 3 AND count(*) FILTER (taxon IN (4, 5, 6)) = 3 AND min_a > max_b""")
def family_expansions(spark, d):
    return M.expansions(V.pangenome(spark, d), GROUP_A, GROUP_B)


@query(f"WITH {V.PAN_SQL} SELECT a.taxon AS t1, b.taxon AS t2, count(*) AS shared FROM pan a JOIN pan b USING (cluster) WHERE a.taxon <> b.taxon GROUP BY ALL")
def pairwise_shared_clusters(spark, d):
    return M.shared_clusters(V.pangenome(spark, d))


@query(f"""WITH {V.PAN_SQL}, t AS (SELECT taxon, sum(n) AS total FROM pan GROUP BY ALL)
  SELECT a.taxon AS t1, b.taxon AS t2, round(100.0::DOUBLE * sum(a.n + b.n)::BIGINT / any_value(x.total + y.total)::BIGINT, 6) AS pocp
  FROM pan a JOIN pan b USING (cluster) JOIN t x ON x.taxon = a.taxon JOIN t y ON y.taxon = b.taxon WHERE a.taxon <> b.taxon GROUP BY ALL""")
def pocp_matrix(spark, d):
    pan = V.pangenome(spark, d)
    return M.pocp(pan, pan.groupBy("taxon").agg(F.sum("n").alias("total"))).withColumn("pocp", F.round("pocp", 6))


@query("""WITH m AS (SELECT l_orderkey AS cluster, l_linenumber AS seq_id, l_returnflag AS taxon, l_quantity::BIGINT AS length FROM lineitem),
  k AS (SELECT cluster, taxon, count(*) AS k FROM m GROUP BY ALL), t AS (SELECT taxon, sum(length)::BIGINT AS residues FROM m GROUP BY ALL)
  SELECT m.taxon AS t1, k.taxon AS t2, round(100.0::DOUBLE * sum(length * k)::BIGINT / any_value(residues), 6) AS af
  FROM m JOIN k USING (cluster) JOIN t ON t.taxon = m.taxon WHERE m.taxon <> k.taxon GROUP BY ALL""")
def af_matrix(spark, d):
    m = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.col("l_linenumber").alias("seq_id"), F.col("l_returnflag").alias("taxon"), F.col("l_quantity").cast("long").alias("length"))
    return M.aligned_fraction(m, m.groupBy("taxon").agg(F.sum("length").alias("residues"))).withColumn("af", F.round("af", 6))


@query(f"""WITH {V.HITS_SQL}, one AS (SELECT tq AS t1, ts AS t2, avg(pident) AS ani FROM hits WHERE tq < ts GROUP BY ALL)
  SELECT t1, t2, round(ani, 6) AS ani FROM one UNION ALL SELECT t2, t1, round(ani, 6) FROM one""")
def avg_identity_matrix(spark, d):
    h = V.hits(spark, d).filter("tq < ts").select(F.col("tq").alias("ta"), F.col("ts").alias("tb"), "pident")
    return M.mean_identity(h).withColumn("ani", F.round("ani", 6))


@query(f"""WITH {V.PAN_SQL}, g AS (SELECT cluster, count(*) AS k, min(n) AS lo, max(n) AS hi FROM pan GROUP BY ALL)
  SELECT pan.* FROM pan JOIN g USING (cluster) WHERE k < (SELECT count(DISTINCT taxon) FROM pan) OR lo <> hi""")
def variable_clusters(spark, d):
    return M.variable_clusters(V.pangenome(spark, d))


@query(f"""WITH {V.PAN_SQL}, c AS (SELECT DISTINCT cluster FROM pan), t AS (SELECT DISTINCT taxon FROM pan)
  SELECT t.taxon, string_agg(CASE WHEN n IS NULL THEN '0' ELSE '1' END, '' ORDER BY c.cluster) AS bits FROM t, c LEFT JOIN pan ON pan.taxon = t.taxon AND pan.cluster = c.cluster GROUP BY ALL""")
def binary_matrix_string(spark, d):
    return M.binary_strings(V.pangenome(spark, d))


@query(f"""WITH {V.PAN_SQL}, c AS (SELECT DISTINCT cluster FROM pan), t AS (SELECT DISTINCT taxon FROM pan),
  f AS (SELECT t.taxon, c.cluster, coalesce(n, 0) AS n FROM t, c LEFT JOIN pan ON pan.taxon = t.taxon AND pan.cluster = c.cluster),
  h AS (SELECT taxon, cluster, n, CASE WHEN hi > lo THEN round(1000000.0::DOUBLE * n / (hi - lo)) ELSE 0 END::BIGINT AS g FROM f JOIN (SELECT cluster, max(n) AS hi, min(n) AS lo FROM f GROUP BY cluster) USING (cluster))
  SELECT a.taxon AS t1, b.taxon AS t2, sum(abs(a.n - b.n))::BIGINT AS manhattan, sum((a.n - b.n) * (a.n - b.n))::BIGINT AS euclid2,
    round((sum(abs(a.g - b.g)))::BIGINT / 1000000.0::DOUBLE / (SELECT count(*) FROM c), 6) AS gower FROM h a JOIN h b USING (cluster) WHERE a.taxon < b.taxon GROUP BY ALL""")
def pairwise_distance(spark, d):
    return M.distances(V.pangenome(spark, d)).withColumn("gower", F.round("gower", 6))


@query(f"WITH {V.PAN_SQL} SELECT taxon, 'a:' || cluster AS cluster, n FROM pan UNION ALL SELECT taxon, 'b:' || cluster, n FROM pan WHERE taxon <= 6")
def matrix_append(spark, d):
    pan = V.pangenome(spark, d)
    return M.append(pan, pan.filter("taxon <= 6"))


_ORDERS_SQL = """ord AS (SELECT s AS sample, taxon, row_number() OVER (PARTITION BY s ORDER BY md5(s || '|' || taxon)) - 1 AS g FROM (SELECT DISTINCT taxon FROM pan), unnest(range(0, 5)) AS u(s))"""
_GROWTH_SQL = f"""{V.PAN_SQL}, {_ORDERS_SQL},
  seen AS (SELECT sample, cluster, g, row_number() OVER (PARTITION BY sample, cluster ORDER BY g) AS k, lead(g) OVER (PARTITION BY sample, cluster ORDER BY g) AS nxt FROM pan JOIN ord USING (taxon)),
  grid AS (SELECT DISTINCT sample, g FROM ord),
  base AS (SELECT sample, g, count(*) FILTER (k = g + 1) AS core, count(*) FILTER (k = 1) AS new FROM grid LEFT JOIN seen USING (sample, g) GROUP BY ALL)"""


def _orders(pan):
    """Five md5-ordered permutations of the taxa: the same in every engine."""
    samples = pan.select("taxon").distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(4))))
    key = F.md5(F.concat_ws("|", F.col("sample").cast("string"), F.col("taxon").cast("string")))
    return samples.withColumn("g", F.row_number().over(W.partitionBy("sample").orderBy(key)) - 1)


@query(f"WITH {_GROWTH_SQL} SELECT sample, g, core, sum(new) OVER (PARTITION BY sample ORDER BY g)::BIGINT AS pan FROM base")
def pan_core_growth(spark, d):
    pan = V.pangenome(spark, d)
    return GR.growth(pan, _orders(pan)).select(F.col("sample").cast("long").alias("sample"), F.col("g").cast("long").alias("g"), "core", "pan")


@query(f"""WITH {_GROWTH_SQL}, held AS (SELECT a.sample, a.g, count(*) AS soft FROM grid a JOIN seen s ON s.sample = a.sample AND s.g <= a.g AND (s.nxt IS NULL OR s.nxt > a.g)
    WHERE s.k >= floor((a.g + 1) * 0.95::DOUBLE) GROUP BY ALL)
  SELECT sample, g, coalesce(soft, 0) AS soft FROM grid LEFT JOIN held USING (sample, g)""")
def soft_core_growth(spark, d):
    pan = V.pangenome(spark, d)
    return GR.growth(pan, _orders(pan), 0.95).select(F.col("sample").cast("long").alias("sample"), F.col("g").cast("long").alias("g"), "soft")


@query(f"""WITH {_GROWTH_SQL}, t AS (SELECT sample, g, sum(new) OVER (PARTITION BY sample ORDER BY g)::BIGINT AS n FROM base) SELECT sample, g, 2 * n AS n FROM t""")
def matrix_add(spark, d):
    t = pan_core_growth(spark, d).select("sample", "g", F.col("pan").alias("n"))
    return M.add_growth(t, t)


# --- hits -------------------------------------------------------------------------------------------------------------

_TIES_SQL = f"{V.HITS_SQL}, ties AS MATERIALIZED (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY q, ts ORDER BY evalue) AS r FROM hits WHERE tq <> ts) WHERE r = 1)"
_BEST_SQL = _TIES_SQL + ", best AS MATERIALIZED (SELECT * FROM ties WHERE pident >= 60 AND least(qcov, scov) >= 45 AND evalue <= 0.01)"
_RECIPROCAL = "SELECT x.q AS a, x.s AS b, x.tq AS ta, x.ts AS tb, ((-log10(x.evalue)) + (-log10(y.evalue))) / 2 AS w FROM {0} x JOIN {0} y ON x.q = y.s AND x.s = y.q WHERE x.q < x.s"


@query(f"WITH {_TIES_SQL} SELECT q, s, tq, ts, bits::BIGINT AS bits FROM ties")
def rbh_ties(spark, d):
    return H.top_ties(V.hits(spark, d)).select("q", "s", "tq", "ts", F.col("bits").cast("long").alias("bits"))


@query(f"WITH {_BEST_SQL} SELECT a, b, ta, tb, round(w, 6) AS w FROM ({_RECIPROCAL.format('best')})")
def rbh_pairs(spark, d):
    return H.reciprocal(Tables(spark, "best").save(H.best(V.hits(spark, d), CFG)), CFG).withColumn("w", F.round("w", 6))


@query(f"""WITH {V.HITS_SQL} SELECT q, s, ts FROM (SELECT *, row_number() OVER (PARTITION BY q, ts ORDER BY rk) AS n FROM hits WHERE tq <> ts AND evalue <= 0.01 AND pident >= 0 AND least(qcov, scov) >= 40) WHERE n = 1""")
def best_homolog(spark, d):
    return H.homologs(V.hits(spark, d), CFG).select("q", "s", "ts")


@query(f"WITH {V.HITS_SQL} SELECT q, s FROM (SELECT *, sum((tq <> ts)::INT) OVER (PARTITION BY q ORDER BY rk) AS f FROM hits) WHERE f = 0")
def prefix_before_foreign(spark, d):
    return H.prefix_before_foreign(V.hits(spark, d)).select("q", "s")


_PARA_SQL = V.HITS_SQL + """, pre AS MATERIALIZED (SELECT * FROM (SELECT *, sum((tq <> ts OR evalue > 0.01 OR pident < 60)::INT) OVER (PARTITION BY q ORDER BY rk) AS f FROM hits) WHERE f = 0 AND least(qcov, scov) >= 45)"""


@query(f"WITH {_PARA_SQL} SELECT a, b, round(w, 6) AS w FROM ({_RECIPROCAL.format('pre')})")
def inparalog_pairs(spark, d):
    return H.reciprocal(Tables(spark, "prefix").save(H.prefix_before_foreign(V.hits(spark, d), CFG)), CFG).select("a", "b", F.round("w", 6).alias("w"))


@query(f"WITH {V.HITS_SQL}, pre AS (SELECT * FROM hits WHERE tq = ts) SELECT b AS seq_id, min(a) AS seed FROM ({_RECIPROCAL.format('pre')}) GROUP BY b")
def inparalog_seed(spark, d):
    return H.seeds(H.reciprocal(Tables(spark, "own").save(V.hits(spark, d).filter("tq = ts")), CFG))


@query(f"""WITH {_BEST_SQL}, o AS ({_RECIPROCAL.format('best')}), pre AS (SELECT * FROM (SELECT *, sum((tq <> ts OR evalue > 0.01 OR pident < 60)::INT) OVER (PARTITION BY q ORDER BY rk) AS f FROM hits) WHERE f = 0 AND least(qcov, scov) >= 45),
  p AS ({_RECIPROCAL.format('pre')}), e AS (SELECT a AS i FROM o UNION SELECT b FROM o),
  h AS (SELECT *, a IN (SELECT i FROM e) OR b IN (SELECT i FROM e) AS l FROM p)
  SELECT a, b, 'ortholog' AS kind, round(w / avg(w) OVER (PARTITION BY least(ta, tb), greatest(ta, tb)), 6) AS w FROM o UNION ALL
  SELECT a, b, 'inparalog', round(w / coalesce(avg(w) FILTER (l) OVER (PARTITION BY ta), avg(w) OVER (PARTITION BY ta)), 6) FROM h""")
def omcl_weights(spark, d):
    return H.omcl_edges(V.hits(spark, d), CFG).select("a", "b", "kind", F.round("w", 6).alias("w"))


@query(f"WITH {V.HITS_SQL} SELECT q, s, tq, ts FROM (SELECT *, row_number() OVER (PARTITION BY q, ts ORDER BY rk) AS n FROM hits) WHERE n <= 2")
def topn_hits_per_group(spark, d):
    return H.top_n(V.hits(spark, d), 2).select("q", "s", "tq", "ts")


@query(f"""WITH {V.HITS_SQL}, f AS (SELECT q, s, ts FROM (SELECT *, row_number() OVER (PARTITION BY q, ts ORDER BY rk) AS n FROM hits) WHERE n <= 1)
  SELECT f.q, f.s, f.ts, b.rk AS back_rk FROM f LEFT JOIN hits b ON b.q = f.s AND b.s = f.q""")
def inspect_best_hits(spark, d):
    h = V.saved_hits(spark, d)
    return H.inspect(h, h.select("q").distinct(), 1).select("q", "s", "ts", F.col("back_rk").cast("long").alias("back_rk"))


@query(f"""WITH {_PARA_SQL}, p AS ({_RECIPROCAL.format('pre')}), seed AS (SELECT b AS i, min(a) AS seed FROM p GROUP BY b),
  col AS MATERIALIZED (SELECT coalesce(x.seed, q) AS q, coalesce(y.seed, s) AS s, tq, ts, evalue, pident, qcov, scov, rk FROM hits LEFT JOIN seed x ON x.i = q LEFT JOIN seed y ON y.i = s),
  t AS MATERIALIZED (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY q, ts ORDER BY evalue) AS r FROM col WHERE tq <> ts) WHERE r = 1),
  back AS (SELECT s AS q, q AS s, min({{'rk': rk, 'e': evalue, 'qc': qcov, 'sc': scov}}) AS b FROM t GROUP BY ALL),
  ok AS (SELECT t.* FROM t LEFT JOIN back USING (q, s) WHERE pident >= 60 AND (least(qcov, scov) >= 45 OR coalesce(least(b.qc, b.sc) >= 45, false)) AND (evalue <= 0.01 OR coalesce(b.e <= 0.01, false))),
  one AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, ts ORDER BY rk, evalue, s, pident, qcov, scov) AS n FROM ok) WHERE n = 1),
  pairs AS (SELECT DISTINCT x.q AS a, x.s AS b, x.tq AS ta, x.ts AS tb FROM one x JOIN one y ON x.q = y.s AND x.s = y.q WHERE x.q < x.s),
  star AS (SELECT a AS c, b AS i FROM pairs WHERE ta = 'Brand#11' UNION SELECT b, a FROM pairs WHERE tb = 'Brand#11'), core AS (SELECT c, i FROM star UNION SELECT c, c FROM star),
  m AS (SELECT c, i FROM core UNION SELECT c, seed.i FROM core JOIN seed ON seed.seed = core.i)
  SELECT c AS cluster_id, i AS seq_id, p_brand AS taxon FROM m JOIN part ON p_partkey = i""")
def bdbh_clusters(spark, d):
    part = V.table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_brand").alias("taxon"))
    return H.bdbh_clusters(V.hits(spark, d), part, "Brand#11", CFG)


# --- graphs and clusters ----------------------------------------------------------------------------------------------

def _pairs(spark, d):
    """All reciprocal best hits."""
    tables = Tables(spark, "pairs")
    return tables.save(H.reciprocal(tables.save(H.top_ties(V.hits(spark, d))), CFG))


_LINKS_SQL = f"{_TIES_SQL}, l AS MATERIALIZED ({_RECIPROCAL.format('ties')})"


@query(f"""WITH RECURSIVE {_LINKS_SQL}, e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
  SELECT node, min(seen) AS component FROM r GROUP BY node""")
def cluster_components(spark, d):
    return G.components(Tables(spark, "components"), _pairs(spark, d).select("a", "b"))


@query()
def mcl_clusters(spark, d):
    return G.mcl(Tables(spark, "mcl"), _pairs(spark, d).select("a", "b", "w"))


@query(f"""WITH {_LINKS_SQL} SELECT x.a AS x, x.b AS y, y.b AS z FROM l x JOIN l y ON x.b = y.a JOIN l z ON z.a = x.a AND z.b = y.b WHERE x.ta <> x.tb AND y.ta <> y.tb AND x.ta <> y.tb""")
def sbh_triangles(spark, d):
    return G.triangles(_pairs(spark, d))


@query(f"""WITH RECURSIVE {_LINKS_SQL}, t AS MATERIALIZED (SELECT x.a AS x, x.b AS y, y.b AS z FROM l x JOIN l y ON x.b = y.a JOIN l z ON z.a = x.a AND z.b = y.b WHERE x.ta <> x.tb AND y.ta <> y.tb AND x.ta <> y.tb),
  sides AS (SELECT x || '-' || y AS s, t FROM (SELECT *, x || '-' || y || '-' || z AS t FROM t) UNION SELECT y || '-' || z, t FROM (SELECT *, x || '-' || y || '-' || z AS t FROM t) UNION SELECT x || '-' || z, t FROM (SELECT *, x || '-' || y || '-' || z AS t FROM t)),
  e AS MATERIALIZED (SELECT DISTINCT a.t AS a, b.t AS b FROM sides a JOIN sides b USING (s)), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
  c AS (SELECT node, min(seen) AS c FROM r GROUP BY node), m AS (SELECT DISTINCT c, unnest([x, y, z]) AS i FROM t JOIN c ON node = x || '-' || y || '-' || z),
  n AS (SELECT m.*, p_brand FROM m JOIN part ON p_partkey = i), g AS (SELECT c, count(DISTINCT p_brand) AS genomes, count(*) AS size FROM n GROUP BY c),
  k AS (SELECT c, i FROM (SELECT *, count(*) OVER (PARTITION BY i) AS k FROM (SELECT n.*, rank() OVER (PARTITION BY i ORDER BY genomes DESC, size DESC) AS r FROM n JOIN g USING (c)) WHERE r = 1) WHERE k = 1)
  SELECT min(i) OVER (PARTITION BY c) AS cluster_id, i AS seq_id FROM k""")
def triangle_clusters(spark, d):
    part = V.table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_brand").alias("taxon"))
    return G.allot(G.triangle_clusters(Tables(spark, "triangles"), _pairs(spark, d)), part)


@query(f"WITH {V.ORDER_CLUSTERS_SQL} SELECT min(seq_id) OVER (PARTITION BY cluster_id, taxon) AS cluster_id, seq_id, taxon AS attribute FROM clusters")
def split_by_attribute(spark, d):
    c = V.order_clusters(spark, d)
    return G.split_by_attribute(c.select("cluster_id", "seq_id"), c.select("seq_id", F.col("taxon").alias("attribute")).distinct())


@query(f"WITH {V.ORDER_CLUSTERS_SQL}, k AS (SELECT cluster_id FROM clusters GROUP BY ALL HAVING count(DISTINCT taxon) >= 4 AND count(DISTINCT taxon) = count(*)) SELECT clusters.* FROM clusters SEMI JOIN k USING (cluster_id)")
def single_copy_clusters(spark, d):
    return C.single_copy(V.order_clusters(spark, d), 4).select("cluster_id", "seq_id", "taxon")


@query(f"WITH {V.ORDER_SETS_SQL} SELECT * FROM keys")
def cluster_set_key(spark, d):
    return C.keyed(V.order_sets(spark, d), F.col("member"))


@query(f"WITH {V.ORDER_SETS_SQL} SELECT key, min(cluster_id) AS cluster_id, max(size) AS size FROM keys GROUP BY key HAVING count(DISTINCT dir) >= 2")
def cluster_intersection(spark, d):
    return C.intersection(C.keyed(V.order_sets(spark, d), F.col("member")), 2, exactly=False)


@query(f"""WITH {V.ORDER_SETS_SQL}, m AS (SELECT key, sum(CASE dir WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END)::BIGINT AS sector FROM (SELECT DISTINCT key, dir FROM keys) GROUP BY key)
  SELECT sector, count(*) AS n FROM m GROUP BY sector""")
def venn_sectors(spark, d):
    return C.sectors(C.keyed(V.order_sets(spark, d), F.col("member")), ["F", "O", "P"])


@query(f"WITH {_LINKS_SQL} SELECT p_partkey AS seq_id, p_brand AS taxon FROM part WHERE p_partkey NOT IN (SELECT a FROM l UNION SELECT b FROM l)")
def unmatched_singletons(spark, d):
    part = V.table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_brand").alias("taxon"))
    return C.singletons(part, _pairs(spark, d).select(F.explode(F.array("a", "b")).alias("seq_id")))


# --- sequences, intervals, alignments ---------------------------------------------------------------------------------

@query("""SELECT doc_id AS seq_id, reverse(translate(text, 'acgtACGT', 'tgcaTGCA')) AS seq FROM documents WHERE text IS NOT NULL""")
def reverse_complement(spark, d):
    return V.sequences(spark, d).select("seq_id", S.reverse_complement(F.col("seq")).alias("seq"))


@query("""WITH h AS (SELECT doc_id, upper(text) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id AS seq_id, min(doc_id) OVER (PARTITION BY t) AS rep_id, count(*) OVER (PARTITION BY t) AS copies FROM h""")
def dedup_identical(spark, d):
    return Q.dedup_identical(V.sequences(spark, d))


@query("""SELECT a.doc_id AS seq_id, min(b.doc_id) AS container FROM documents a JOIN documents b ON length(b.text) > length(a.text) AND contains(b.text, a.text) GROUP BY ALL""")
def contained_sequences(spark, d):
    return Q.contained(V.sequences(spark, d))


@query("""SELECT lang, doc_id AS seq_id, length FROM (SELECT lang, doc_id, length(text) AS length, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1""")
def longest_per_group(spark, d):
    s = V.sequences(spark, d).select(F.col("taxon").alias("lang"), "seq_id", F.length("seq").cast("long").alias("length"))
    return Q.longest_per_group(s, "lang")


@query("SELECT lang AS taxon, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n, sum(length(text))::BIGINT AS residues FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def taxon_ranges(spark, d):
    return Q.taxon_ranges(V.sequences(spark, d))


@query("""WITH g AS (SELECT l_orderkey * 10 + l_linenumber AS seq_id, l_orderkey AS contig, l_linenumber::BIGINT AS "start", CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END::BIGINT AS strand FROM lineitem)
  SELECT *, lag(seq_id) OVER w AS left_id, lag(strand) OVER w AS left_strand, lead(seq_id) OVER w AS right_id, lead(strand) OVER w AS right_strand FROM g WINDOW w AS (PARTITION BY contig ORDER BY "start", seq_id, strand)""")
def neighbour_lag_lead(spark, d):
    return Q.neighbours(V.genes(spark, d))


@query(f"""WITH {V.INTERVALS_SQL} SELECT user_id, sum(greatest("end" - greatest("start" - 1, coalesce(r, "start" - 1)), 0))::BIGINT AS covered
  FROM (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv) GROUP BY ALL""")
def interval_union_length(spark, d):
    return I.union_length(V.intervals(spark, d), "user_id")


@query(f"""WITH RECURSIVE {V.INTERVALS_SQL}, g AS (SELECT user_id AS q, event_id % 5 AS s, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id DESC) AS i, event_id, "start" AS a, "end" AS b FROM iv),
  f AS (SELECT q, s, i, [{{'a': a, 'b': b, 'id': event_id}}] AS kept FROM g WHERE i = 1 UNION ALL
    SELECT g.q, g.s, g.i, CASE WHEN len(list_filter(kept, lambda k: (g.a + g.b) / 2.0::DOUBLE BETWEEN k.a AND k.b)) > 0 THEN kept ELSE list_append(kept, {{'a': g.a, 'b': g.b, 'id': g.event_id}}) END FROM f JOIN g ON g.q = f.q AND g.s = f.s AND g.i = f.i + 1),
  z AS (SELECT q, s, kept, list_sum(list_transform(kept, lambda k: k.b - k.a + 1))::BIGINT AS span FROM (SELECT *, max(i) OVER (PARTITION BY q, s) AS top FROM f) WHERE i = top)
  SELECT q, s, 1.0::DOUBLE / (kept[1].id + 1) AS evalue, round(list_sum(list_transform(kept, lambda k: (k.b - k.a)::DOUBLE)) / len(kept), 2) AS pident, round_even(100.0::DOUBLE * span / 2700000, 0) AS qcov, round_even(100.0::DOUBLE * span / 2700000, 0) AS scov,
    2700000 AS qlen, 2700000 AS slen, array_to_string(list_transform(kept, lambda k, i: i || ':' || k.a || '-' || k.b || ':' || k.a || '-' || k.b || '.'), '') AS simspan, list_sum(list_transform(kept, lambda k: k.id::DOUBLE)) AS bits FROM z""")
def hsp_fold(spark, d):
    return I.fold_hsps(segments(spark, d))


def segments(spark, d):
    """Events as segments: users as queries, residues of five as subjects."""
    iv = V.intervals(spark, d)
    return iv.select(F.col("user_id").alias("q"), (F.col("event_id") % 5).alias("s"), (F.col("end") - F.col("start")).cast("double").alias("pident"), F.lit(0).alias("alen"), F.lit(2_700_000).alias("qlen"), F.lit(2_700_000).alias("slen"),
                    F.col("start").cast("int").alias("qs"), F.col("end").cast("int").alias("qe"), F.col("start").cast("int").alias("ss"), F.col("end").cast("int").alias("se"), (F.lit(1.0) / (F.col("event_id") + 1)).alias("evalue"), F.col("event_id").cast("double").alias("bits"))


@query(f"""WITH {V.ALIGNMENT_SQL}, n AS (SELECT aln, pos, ch, count(*) AS n FROM ch GROUP BY ALL)
  SELECT aln, pos, count(*) FILTER (ch <> '-') AS letters, count(*) FILTER (ch = '-') = 0 AS snp, count(*) FILTER (n >= 2) >= 2 AS informative FROM n GROUP BY ALL HAVING letters >= 2""")
def alignment_variants(spark, d):
    return A.variants(V.alignment(spark, d))


# --- statistics -------------------------------------------------------------------------------------------------------

def _enrichment(spark, d):
    li = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = li.select(F.col("l_orderkey").alias("cluster"), F.col("l_partkey").alias("seq_id"), F.array("p_brand").alias("domains"), "l_returnflag")
    return ST.enrichment_counts(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag = 'N'"))


@query("""SELECT p_brand AS domain, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS exp, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'N') AS ctrl
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('R', 'N') GROUP BY ALL""")
def set_enrichment_counts(spark, d):
    return _enrichment(spark, d)


@query("""WITH c AS (SELECT p_brand AS domain, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS a, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'N') AS b
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('R', 'N') GROUP BY ALL),
  t AS (SELECT *, (sum(a) OVER ())::BIGINT AS c, (sum(b) OVER ())::BIGINT AS d FROM c), u AS (SELECT *, a + b AS r, a + c AS k, a + b + c + d AS n FROM t),
  x AS (SELECT *, unnest(range(a, least(r, k) + 1)) AS i FROM u),
  p AS (SELECT domain, a, b, c, d, least(1.0, sum(exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(n - k + 1) - lgamma(r - i + 1) - lgamma(n - k - r + i + 1)
      - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1)))) AS p FROM x GROUP BY ALL),
  q AS (SELECT *, count(*) OVER () * p / (count(*) OVER () - row_number() OVER (ORDER BY p DESC, domain) + 1) AS v, row_number() OVER (ORDER BY p DESC, domain) AS o FROM p)
  SELECT domain, a AS exp, b AS ctrl, c AS exp_total, d AS ctrl_total, round(p, 6) AS p, round(least(1.0, min(v) OVER (ORDER BY o)), 6) AS q FROM q""")
def set_enrichment_fisher(spark, d):
    return ST.enrichment(_enrichment(spark, d), cutoff=1.0).withColumns({"p": F.round("p", 6), "q": F.round("q", 6)})


@query(f"""WITH {V.HITS_SQL}, x AS (SELECT q, s, bits, (q % 97 + 50)::DOUBLE * (s % 89 + 50) AS lp FROM hits WHERE bits >= 100), c AS (SELECT CASE WHEN count(*) < 100 THEN count(*) WHEN count(*) > 5000 THEN 1000 WHEN count(*) > 1000 THEN 200 ELSE 20 END AS k FROM x),
  b AS (SELECT x.*, (row_number() OVER (ORDER BY lp, q, s) - 1) // (SELECT k FROM c) AS bin FROM x),
  r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY bits DESC, q, s) AS r, count(*) OVER (PARTITION BY bin) AS n FROM b),
  f AS (SELECT regr_slope(log10(bits), log10(lp)) AS m, regr_intercept(log10(bits), log10(lp)) AS i FROM r WHERE r <= greatest(floor(n * 5 / 100), 1))
  SELECT q, s, round(100 * bits / (pow(10, i) * pow((q % 97 + 50)::DOUBLE * (s % 89 + 50), m)), 4) AS norm FROM hits, f""")
def score_normalisation(spark, d):
    h = Tables(spark, "hits").save(V.hits(spark, d).select("q", "s", "bits")).select("q", "s", "bits", (F.col("q") % 97 + 50).alias("qlen"), (F.col("s") % 89 + 50).alias("slen"))
    return ST.normalise_scores(h).select("q", "s", F.round("norm", 4).alias("norm"))


def _load() -> None:
    from panweave.plans import analyses, arrivals, files, filters_and_sinks, further  # noqa: F401  register their queries


_load()

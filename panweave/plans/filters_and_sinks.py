"""Further queries: cluster filters, containment, synteny, alignments, statistics, and lines of the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panweave.functions import frames
from panweave.operators import clusters as C
from panweave.operators import graph as G
from panweave.operators import growth as GR
from panweave.operators import homology as H
from panweave.operators import intervals as I
from panweave.operators import matrix as M
from panweave.operators import msa as A
from panweave.operators import sequences as Q
from panweave.operators import stats as ST
from panweave.plans import registry as R
from panweave.plans import views as V
from panweave.plans.registry import query
from panweave.sources import sinks
from panweave.streaming import incremental
from panweave.tables import Tables

_C = V.ORDER_CLUSTERS_SQL


@query(f"WITH {_C}, k AS (SELECT cluster_id FROM clusters GROUP BY ALL HAVING count(DISTINCT taxon) >= 6) SELECT clusters.* FROM clusters SEMI JOIN k USING (cluster_id)")
def min_taxa_clusters(spark, d):
    return C.min_taxa(V.order_clusters(spark, d), 6).select("cluster_id", "seq_id", "taxon")


@query(f"WITH {_C}, k AS (SELECT cluster_id FROM clusters GROUP BY cluster_id, taxon HAVING count(*) > 1) SELECT clusters.* FROM clusters ANTI JOIN k USING (cluster_id)")
def clusters_without_inparalogs(spark, d):
    return C.without_inparalogs(V.order_clusters(spark, d)).select("cluster_id", "seq_id", "taxon")


@query(f"WITH {_C}, c AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM clusters WHERE taxon IN ('Brand#11', 'Brand#12', 'Brand#13')) SELECT cluster_id, seq_id, taxon FROM c WHERE n = 3")
def clusters_of_listed_taxa(spark, d):
    listed = spark.createDataFrame([(f"Brand#{k}",) for k in (11, 12, 13)], "taxon string")
    return C.only_taxa(V.order_clusters(spark, d), listed, 3)


@query("""WITH c AS (SELECT l_orderkey AS cluster_id, l_partkey AS seq_id, l_linenumber AS place, l_quantity::BIGINT AS length FROM lineitem),
  f AS (SELECT *, first(length) OVER (PARTITION BY cluster_id ORDER BY place, length, seq_id) AS f FROM c), k AS (SELECT * FROM f WHERE 100 * least(length, f) >= 60 * greatest(length, f))
  SELECT cluster_id, seq_id, place, length FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM k) WHERE n >= 2""")
def similar_length_members(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("seq_id"), F.struct("l_linenumber", F.col("l_quantity").cast("long"), "l_partkey").alias("place"), F.col("l_quantity").cast("long").alias("length"))
    return C.similar_length(li, 60, 2).select("cluster_id", "seq_id", F.col("place.l_linenumber").alias("place"), "length")


@query(f"WITH {_C}, k AS (SELECT cluster_id FROM clusters GROUP BY ALL HAVING count(DISTINCT taxon) >= 7), i AS (SELECT seq_id FROM clusters SEMI JOIN k USING (cluster_id)) SELECT p_brand AS taxon, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT seq_id FROM i) GROUP BY ALL")
def small_cluster_flags(spark, d):
    part = V.table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_brand").alias("taxon"))
    return C.small_cluster_members(part, V.order_clusters(spark, d), 7)


@query("""WITH r AS (SELECT DISTINCT l_suppkey * 100000 + l_partkey % 50 AS ref_id, l_partkey AS m FROM lineitem), c AS (SELECT DISTINCT l_partkey AS m, l_suppkey AS cluster_id FROM lineitem),
  s AS (SELECT ref_id, count(*) AS s FROM r GROUP BY ALL), h AS (SELECT ref_id, cluster_id, count(*) AS n FROM r JOIN c USING (m) GROUP BY ALL)
  SELECT ref_id, min(cluster_id) AS cluster_id FROM h JOIN s USING (ref_id) WHERE n = s GROUP BY ref_id HAVING count(*) = 1""")
def contained_reference(spark, d):
    li = V.table(spark, d, "lineitem")
    ref = li.select((F.col("l_suppkey") * 100000 + F.col("l_partkey") % 50).alias("ref_id"), F.col("l_partkey").alias("seq_id")).distinct()
    return C.contained_in_one(ref, li.select(F.col("l_partkey").alias("seq_id"), F.col("l_suppkey").alias("cluster_id")).distinct())


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS cluster_id, l_orderkey * 10 + l_linenumber AS seq_id, l_returnflag AS taxon FROM lineitem),
  t AS (SELECT cluster_id, string_agg(DISTINCT taxon, ',' ORDER BY taxon) AS t, count(DISTINCT taxon) AS k FROM m GROUP BY ALL),
  g AS (SELECT a.seq_id AS x, b.seq_id AS y FROM m a JOIN m b ON b.seq_id IN (a.seq_id - 1, a.seq_id + 1)),
  p AS (SELECT a.cluster_id, b.cluster_id AS other, count(DISTINCT a.taxon) AS met FROM m a JOIN g ON g.x = a.seq_id JOIN m b ON b.seq_id = g.y WHERE a.cluster_id <> b.cluster_id GROUP BY ALL)
  SELECT DISTINCT p.cluster_id FROM p JOIN t a ON a.cluster_id = p.cluster_id JOIN t b ON b.cluster_id = p.other WHERE a.t = b.t AND met = a.k""")
def syntenic_clusters(spark, d):
    li = V.table(spark, d, "lineitem")
    m = li.select(F.col("l_suppkey").alias("cluster_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq_id"), F.col("l_returnflag").alias("taxon")).distinct()
    ids = m.select("seq_id").distinct()
    near = ids.select("seq_id", F.explode(F.array(F.col("seq_id") - 1, F.col("seq_id") + 1)).alias("neighbour")).join(ids.withColumnRenamed("seq_id", "neighbour"), "neighbour").select("seq_id", "neighbour")
    return C.syntenic(m, near)


@query(f"WITH {V.PAN_SQL}, o AS (SELECT taxon, count(*) AS own FROM pan GROUP BY ALL), s AS (SELECT a.taxon AS t1, b.taxon AS t2, count(*) AS n FROM pan a JOIN pan b USING (cluster) WHERE a.taxon <> b.taxon GROUP BY ALL) SELECT round(avg(100.0::DOUBLE * n / own), 6) AS percent FROM s JOIN o ON o.taxon = t1")
def mean_shared_percent(spark, d):
    return M.mean_shared_percent(V.pangenome(spark, d)).select(F.round("percent", 6).alias("percent"))


@query(f"""WITH {V.PAN_SQL}, s AS (SELECT a.taxon AS t1, b.taxon AS t2, count(*) AS n FROM pan a JOIN pan b USING (cluster) WHERE a.taxon <> b.taxon GROUP BY ALL)
  SELECT DISTINCT taxon FROM pan WHERE taxon NOT IN (SELECT t1 FROM s WHERE n > (SELECT avg(n) FROM s) * 1.05)""")
def nonredundant_taxa(spark, d):
    pan = V.pangenome(spark, d)
    s = Tables(spark, "shared").save(M.shared_clusters(pan))
    cut = s.agg(F.avg("shared") * F.lit(1.05)).first()[0]
    return M.drop_redundant(s, pan.select("taxon").distinct(), "shared", cut)


@query("""WITH m AS (SELECT l_orderkey AS cluster, l_partkey AS seq_id, l_quantity::BIGINT AS length FROM lineitem), s AS (SELECT cluster, list(length ORDER BY length, seq_id) AS l, list(seq_id ORDER BY length, seq_id) AS i FROM m GROUP BY ALL)
  SELECT cluster, l[1 + len(l) // 2] AS median, list_min(list_filter(i, lambda x, k: l[k] = l[1 + len(l) // 2])) AS rep FROM s""")
def median_length_representative(spark, d):
    m = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.col("l_partkey").alias("seq_id"), F.col("l_quantity").cast("long").alias("length"))
    return M.median_length(m)


@query(f"WITH {V.INTERVALS_SQL} SELECT user_id, event_id % 3 AS grp, min(\"start\") AS \"start\", max(\"end\") AS \"end\" FROM iv GROUP BY ALL")
def aligned_span(spark, d):
    return I.span(V.intervals(spark, d).withColumn("grp", F.col("event_id") % 3), ["user_id", "grp"])


@query(f"""WITH {V.HITS_SQL}, s AS (SELECT * FROM hits), p AS (SELECT DISTINCT least(q, s) AS a, greatest(q, s) AS b FROM s),
  l AS (SELECT a, b, s, round_even(log10(bits), 0) AS va FROM p JOIN s ON s.q = p.a), r AS (SELECT a, b, s, round_even(log10(bits), 0) AS vb FROM p JOIN s ON s.q = p.b),
  f AS (SELECT coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, coalesce(va, round_even(log10(28.0), 0)) AS va, coalesce(vb, round_even(log10(28.0), 0)) AS vb FROM l FULL JOIN r ON l.a = r.a AND l.b = r.b AND l.s = r.s)
  SELECT a, b, round(CASE WHEN corr(va, vb) IS NULL OR isnan(corr(va, vb)) THEN 1 ELSE corr(va, vb) END, 7) AS r FROM f GROUP BY ALL""")
def neighbour_correlation(spark, d):
    return H.neighbour_correlation(V.hits(spark, d), None, R.CFG).select("a", "b", F.round("r", 7).alias("r"))


@query("""WITH d AS (SELECT DISTINCT p_partkey AS g, p_partkey - p_partkey % 3 AS k FROM part WHERE p_partkey % 3 <> 0)
  SELECT g AS gone, k AS keep FROM d""")
def absorbed_clusters(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("gone"), (F.col("p_partkey") - F.col("p_partkey") % 3).alias("keep")).filter("gone <> keep")
    return G.absorb_clusters(Tables(spark, "absorb"), p)[1].select("gone", "keep")


@query(f"""WITH {V.ALIGNMENT_SQL}, k AS (SELECT aln, pos FROM ch GROUP BY ALL HAVING count(*) FILTER (ch <> '-') > 0)
  SELECT aln, name, string_agg(ch, '' ORDER BY pos) AS seq FROM ch SEMI JOIN k USING (aln, pos) GROUP BY ALL""")
def alignment_without_gap_columns(spark, d):
    return Q.remove_gap_columns(V.alignment(spark, d))


@query(f"""WITH {V.ALIGNMENT_SQL}, n AS (SELECT aln, pos, ch, count(*) AS n FROM ch GROUP BY ALL),
  c AS (SELECT aln, pos, count(*) FILTER (ch <> '-') AS l, count(*) FILTER (ch = '-') = 0 AS snp, count(*) FILTER (n >= 2) >= 2 AS inf FROM n GROUP BY ALL HAVING l >= 2)
  SELECT aln, sum(snp::INT)::BIGINT AS snps, sum(inf::INT)::BIGINT AS informative FROM c GROUP BY ALL""")
def alignment_variant_counts(spark, d):
    return A.variant_counts(V.alignment(spark, d))


@query(f"""WITH {V.ALIGNMENT_SQL}, e AS (SELECT *, length(regexp_extract(seq, '^(-*)', 1)) AS a, length(regexp_extract(seq, '(-*)$', 1)) AS z FROM msa), c AS (SELECT aln, max(a) AS a, max(z) AS z FROM e GROUP BY ALL)
  SELECT msa.aln, name, substr(seq, c.a + 1, greatest(length(seq) - c.a - c.z, 0)) AS seq FROM msa JOIN c ON c.aln = msa.aln""")
def blunt_alignment(spark, d):
    return A.blunt(V.alignment(spark, d))


@query("""SELECT l_returnflag AS file, round(avg(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END), 6) AS omega, count(*) AS pairs FROM lineitem WHERE l_suppkey % 7 >= 4 GROUP BY ALL""")
def rate_summary(spark, d):
    r = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("file"), F.when(F.col("l_linenumber") == 7, 99.0).otherwise(F.col("l_quantity")).alias("omega"), (F.col("l_suppkey") % 7).alias("n_of_seqs"))
    return ST.rate_summary(r).withColumn("omega", F.round("omega", 6))


@query("""SELECT l_linenumber AS occ, count(*) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, median(l_quantity) AS median, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS population_sd FROM lineitem GROUP BY ALL""")
def rates_by_occupancy(spark, d):
    r = V.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("occ"), F.col("l_quantity").alias("omega"))
    return ST.by_occupancy(r).withColumns({c: F.round(c, 6) for c in ("mean", "sd", "population_sd")})


@query("""WITH g AS (SELECT l_linenumber AS occ, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY ALL), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS gm FROM g),
  a AS (SELECT (sum(g.n * (m - gm) * (m - gm)) / (any_value(k) - 1)) / (sum(g.n * v) / (any_value(t.n) - any_value(k))) AS f FROM g, t)
  SELECT round(corr(l_linenumber, l_quantity), 6) AS r, round(regr_slope(l_quantity, l_linenumber), 6) AS slope, round(regr_intercept(l_quantity, l_linenumber), 6) AS intercept, round(any_value(a.f), 4) AS f FROM lineitem, a""")
def rate_trend(spark, d):
    r = V.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("occ"), F.col("l_quantity").alias("omega"))
    return ST.trend(r).select(*[F.round(c, 6).alias(c) for c in ("r", "slope", "intercept")], F.round("f", 4).alias("f"))


@query(f"WITH {V.PAN_SQL}, s AS (SELECT DISTINCT taxon AS ta, taxon % 3 + 1 AS tb FROM pan) SELECT a.taxon AS ta, b.taxon AS tb FROM (SELECT DISTINCT taxon FROM pan) a, (SELECT DISTINCT taxon FROM pan) b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.ta = a.taxon AND s.tb = b.taxon)")
def pending_pairs(spark, d):
    taxa = V.pangenome(spark, d).select("taxon").distinct()
    return incremental.pending_pairs(taxa, taxa.select(F.col("taxon").alias("ta"), (F.col("taxon") % 3 + 1).alias("tb")))


@query(f"""WITH {V.PAN_SQL}, {R._ORDERS_SQL}, g AS (SELECT DISTINCT l_partkey AS seq_id, month(l_shipdate)::BIGINT AS taxon FROM lineitem),
  h AS (SELECT DISTINCT l_partkey AS q, month(l_shipdate)::BIGINT AS ts FROM lineitem), f AS (SELECT q, sample, min(g) AS f FROM h JOIN ord ON ord.taxon = ts GROUP BY ALL)
  SELECT o.sample, o.g, count(*) AS new FROM (SELECT * FROM g WHERE seq_id % 13 <> 0) g JOIN ord o USING (taxon) LEFT JOIN f ON f.q = g.seq_id AND f.sample = o.sample WHERE f.f IS NULL OR f.f >= o.g GROUP BY ALL""")
def pan_increments(spark, d):
    li = V.table(spark, d, "lineitem")
    genes = li.select(F.col("l_partkey").alias("seq_id"), F.month("l_shipdate").cast("long").alias("taxon")).distinct()
    hom = li.select(F.col("l_partkey").alias("q"), F.month("l_shipdate").cast("long").alias("ts")).distinct()
    orders = R._orders(V.pangenome(spark, d))
    return GR.pan_increments(genes, hom, genes.filter("seq_id % 13 = 0").select("seq_id").distinct(), orders).select(F.col("sample").cast("long").alias("sample"), F.col("g").cast("long").alias("g"), "new")


@query(f"""WITH {V.PAN_SQL}, c AS (SELECT DISTINCT cluster FROM pan), t AS (SELECT DISTINCT taxon FROM pan), f AS (SELECT t.taxon, c.cluster, coalesce(n, 0) AS n FROM t, c LEFT JOIN pan ON pan.taxon = t.taxon AND pan.cluster = c.cluster)
  SELECT 'source:x' || chr(9) || string_agg(cluster, chr(9) ORDER BY cluster) AS value FROM c UNION ALL SELECT taxon || chr(9) || string_agg(n, chr(9) ORDER BY cluster) FROM f GROUP BY taxon""")
def matrix_lines(spark, d):
    return sinks.matrix_lines(V.pangenome(spark, d), "x").select("value")


@query(f"""WITH {V.PAN_SQL}, c AS (SELECT DISTINCT cluster FROM pan), t AS (SELECT DISTINCT taxon FROM pan), f AS (SELECT t.taxon, c.cluster, coalesce(n, 0) AS n FROM t, c LEFT JOIN pan ON pan.taxon = t.taxon AND pan.cluster = c.cluster)
  SELECT 'source:x' || chr(9) || string_agg(taxon, chr(9) ORDER BY taxon) AS value FROM t UNION ALL SELECT cluster || chr(9) || string_agg(n, chr(9) ORDER BY taxon) FROM f GROUP BY cluster""")
def transposed_matrix_lines(spark, d):
    return sinks.matrix_lines(V.pangenome(spark, d), "x", transposed=True).select("value")


@query(f"""WITH {V.PAN_SQL}, c AS (SELECT DISTINCT cluster FROM pan), t AS (SELECT DISTINCT taxon FROM pan), f AS (SELECT t.taxon, c.cluster, n FROM t, c LEFT JOIN pan ON pan.taxon = t.taxon AND pan.cluster = c.cluster),
  r AS (SELECT row_number() OVER (ORDER BY taxon) - 1 AS i, string_agg(CASE WHEN n > 0 THEN '1' ELSE '0' END, '' ORDER BY cluster) AS b FROM f GROUP BY taxon)
  SELECT format('{{:>10}} {{:>6}}', (SELECT count(*) FROM t), (SELECT count(*) FROM c)) AS value UNION ALL SELECT lpad(i::VARCHAR, 10, '0') || '    ' || b FROM r""")
def phylip_lines(spark, d):
    return sinks.phylip_lines(V.pangenome(spark, d)).select("value")


@query("SELECT doc_id AS seq_id, '>' || source || chr(10) || text AS value FROM documents WHERE text IS NOT NULL")
def fasta_lines(spark, d):
    return sinks.fasta_lines(V.sequences(spark, d)).select("seq_id", "value")


@query("""WITH b AS (SELECT o_orderstatus AS taxon, min(o_orderkey) AS f, max(o_orderkey) AS l FROM orders GROUP BY ALL)
  SELECT l_orderkey AS seq_id, taxon FROM lineitem JOIN b ON l_orderkey BETWEEN f AND l """)
def taxon_by_range(spark, d):
    b = V.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("taxon")).agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    return Q.taxon_of_id(V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq_id")), b)


@query(f"""WITH s AS (SELECT doc_id AS seq_id, text AS t, reverse(translate(text, 'acgtACGT', 'tgcaTGCA')) AS r FROM documents WHERE text IS NOT NULL),
  f AS (SELECT seq_id, k AS frame, t AS x, k AS o FROM s, unnest([1, 2, 3]) AS u(k) UNION ALL SELECT seq_id, -k, r, k FROM s, unnest([1, 2, 3]) AS u(k)),
  g AS (SELECT seq_id, frame, substr(translate(x, 'acgtuU', 'ACGTTT'), o) AS x FROM f)
  SELECT seq_id, frame, array_to_string(list_transform(range(0, length(x) // 3), lambda i: coalesce(({R.CODON_MAP})[substr(x, 3 * i + 1, 3)], 'X')), '') AS protein FROM g""")
def six_frame_translation(spark, d):
    return V.sequences(spark, d).select("seq_id", "seq").mapInArrow(frames.six_frames, frames.FRAMES)

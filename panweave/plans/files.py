"""Sources and sinks as queries: rows of the driver's tables are written in a format, read back and returned.

Every query writes to a folder of the shared place and reads it with the library's own source, so its SQL twin states
what has to come back from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.functions import sequences as S
from panweave.functions import transcripts
from panweave.operators import clusters as C
from panweave.operators import growth as GR
from panweave.operators import intervals as I
from panweave.operators import matrix as M
from panweave.operators import sequences as Q
from panweave.plans import registry as R
from panweave.operators.ranks import ranked
from panweave.plans import views as V
from panweave.plans.registry import query
from panweave.sources import genbank, sinks, text
from panweave.tables import Tables

_C = V.ORDER_CLUSTERS_SQL


def _folder(spark: SparkSession, name: str) -> str:
    return Tables(spark, "files").folder(name)


def _write(lines: DataFrame, name: str) -> str:
    """lines(value) as a text; lines(ord, value) in that order."""
    path = _folder(lines.sparkSession, name)
    if "ord" in lines.columns:
        sinks.write_lines(lines, path)
    else:
        lines.select("value").write.text(path)
    return path


def _tsv(rows: DataFrame, name: str, header: bool = False, compression: str = "none") -> str:
    path = _folder(rows.sparkSession, name)
    rows.write.csv(path, sep="\t", header=header, nullValue="NULL", quote="", compression=compression)
    return path


# --- FASTA ------------------------------------------------------------------------------------------------------------

_RECORDS_SQL = """rec AS (SELECT doc_id, 'd' || doc_id || ' ' || coalesce(source, '') || ' [' || upper(coalesce(lang, 'xx')) || ' strain]' AS header, upper(coalesce(lang, 'xx')) || ' strain' AS taxon,
  regexp_replace(text, '[^A-Za-z]', '', 'g') AS seq FROM documents WHERE regexp_matches(text, '[A-Za-z]'))"""


def _records(spark, d) -> DataFrame:
    """Documents as sequence records of their letters, with a taxon in brackets."""
    lang = F.upper(F.coalesce("lang", F.lit("xx")))
    docs = V.table(spark, d, "documents").filter(F.col("text").rlike("[A-Za-z]"))
    header = F.concat(F.lit("d"), "doc_id", F.lit(" "), F.coalesce("source", F.lit("")), F.lit(" ["), lang, F.lit(" strain]"))
    return docs.select("doc_id", header.alias("header"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))


@query(f"WITH {_RECORDS_SQL} SELECT header, seq FROM rec")
def fasta_scan(spark, d):
    return text.fasta(spark, _write(sinks.fasta_lines(_records(spark, d), width=60), "records")).select("header", "seq")


@query(f"""WITH {_RECORDS_SQL}, {V.ALIGNMENT_SQL} SELECT header, seq FROM rec WHERE NOT regexp_matches(seq, '(?i)[QEIPDFHLV]')
  UNION ALL SELECT 'v' || name, seq FROM msa""")
def fasta_scan_options(spark, d):
    """Gaps stay, peptides go: aligned nucleotides and document letters in one file."""
    aligned = V.alignment(spark, d).select(F.concat(F.lit("v"), "name").alias("header"), "seq")
    path = _write(sinks.fasta_lines(_records(spark, d).select("header", "seq").unionByName(aligned)), "mixed")
    return text.fasta(spark, path, skip_peptides=True, keep_gaps=True).select("header", "seq")


@query(f"WITH {_RECORDS_SQL} SELECT header, seq FROM rec")
def fasta_scan_unnamed_gzip(spark, d):
    """Compressed files whose names don't say so: written with gzip, then read by their first bytes."""
    path = _folder(spark, "packed")
    sinks.fasta_lines(_records(spark, d), width=70).select("value").write.option("compression", "gzip").text(path)
    return text.packed_fasta(spark, path).select("header", "seq")


@query(f"WITH {_RECORDS_SQL} SELECT taxon, count(*) AS n FROM rec GROUP BY ALL")
def taxon_labels(spark, d):
    return text.taxa_of(text.fasta(spark, _write(sinks.fasta_lines(_records(spark, d)), "labels")))


@query(f"""WITH {_RECORDS_SQL}, p AS (SELECT * FROM rec WHERE NOT regexp_full_match(seq, '(?i)[ACGTUXN]+'))
  SELECT taxon, dense_rank() OVER (ORDER BY taxon)::INT AS ord, row_number() OVER (ORDER BY taxon, doc_id) AS seq_id, header FROM p""")
def single_fasta_by_taxon(spark, d):
    rec = _records(spark, d).withColumnRenamed("doc_id", "ord")
    found = text.fasta(spark, _write(sinks.fasta_lines(rec), "single"))
    own = F.regexp_extract("header", r"^d(\d+)", 1).cast("long")  # a text of many parts has no order of its own
    return text.by_taxon(found.withColumn("pos", own)).select("taxon", "ord", "seq_id", "header")


@query("""WITH r AS (SELECT coalesce(source, '') AS file, doc_id FROM documents) SELECT file, doc_id, row_number() OVER (ORDER BY file, doc_id) AS seq_id FROM r""")
def numbered_records(spark, d):
    docs = V.table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("file"), "doc_id")
    files = docs.select("file").distinct().select("file", F.row_number().over(W.orderBy("file")).alias("ord"))
    return Q.number(docs.join(files, "file"), ["doc_id"]).select("file", "doc_id", "seq_id")


@query("""WITH f AS (SELECT DISTINCT coalesce(source, '') AS file FROM documents), s AS (SELECT file, row_number() OVER (ORDER BY md5(file)) AS ord FROM f WHERE length(file) % 2 = 0)
  SELECT file, ord FROM s UNION ALL SELECT file, row_number() OVER (ORDER BY file) + (SELECT count(*) FROM s) FROM f WHERE file NOT IN (SELECT file FROM s)""")
def stored_input_order(spark, d):
    found = V.table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("file")).distinct()
    stored = found.filter("length(file) % 2 = 0").select("file", F.row_number().over(W.orderBy(F.md5("file"))).alias("ord"))
    return text.input_order(found, stored)


@query("""WITH f AS (SELECT coalesce(source, 'none') || CASE WHEN hash % 2 = 0 THEN '.faa' ELSE '.txt' END AS file, value FROM (
    SELECT source, ascii(right(coalesce(source, 'none'), 1)) AS hash, 'd' || doc_id AS value FROM documents))
  SELECT file, sum(length(value) + 1)::BIGINT AS length FROM f WHERE file LIKE '%.faa' GROUP BY file""")
def input_files(spark, d):
    """Documents written to a file a source, of two kinds; the files of one kind are found again, with their sizes."""
    source = F.coalesce("source", F.lit("none"))
    kind = F.when(F.ascii(F.right(source, F.lit(1))) % 2 == 0, ".faa").otherwise(".txt")
    rows = V.table(spark, d, "documents").select(F.concat(source, kind).alias("file"), F.col("doc_id").alias("ord"), F.concat(F.lit("d"), "doc_id").alias("value"))
    folder = sinks.write_reports(rows, _folder(spark, "inputs"))
    return text.files(spark, folder, r"\.faa$", r"/file=([^/]+)/[^/]+$")


@query("""WITH l AS (SELECT * FROM (VALUES (1, 'fr'), (2, 'en'), (3, 'es')) AS t(ord, taxon))
  SELECT row_number() OVER (ORDER BY ord, doc_id) AS seq_id, taxon, doc_id FROM documents JOIN l ON lang = taxon""")
def include_list(spark, d):
    listed = text.names(spark, sinks.write_reports(spark.createDataFrame([("a", 0, "# taxa in their order"), ("a", 1, "fr"), ("a", 2, ""), ("a", 3, "en of two"), ("a", 4, "es")], "file string, ord int, value string"), _folder(spark, "names")))
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("taxon"), "doc_id")
    return Q.include(docs, listed)


@query("SELECT l_orderkey AS file, l_partkey AS seq_id, min(l_partkey) OVER (PARTITION BY l_orderkey) AS rep_id FROM lineitem")
def preclustered_representatives(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("seq_id"))
    return Q.representatives(li)


_DNA = "translate(md5({0}::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _dna(key: Column) -> Column:
    """32 bases from a key."""
    return F.translate(F.md5(key.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")


@query(f"""WITH s AS (SELECT p_partkey AS seq_id, {_DNA.format("p_partkey")} AS dna FROM part), t AS (SELECT *, substr(dna, 1, length(dna) - length(dna) % 3) AS whole FROM s),
  p AS (SELECT *, array_to_string(list_transform(range(0, 10), lambda i: ({R.CODON_MAP})[substr(dna, 3 * i + 1, 3)]), '') AS protein FROM t)
  SELECT seq_id, whole, protein, regexp_matches(protein, '\\*[A-Za-z]') AS bad FROM p""")
def coding_sequence_check(spark, d):
    s = V.table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), _dna(F.col("p_partkey")).alias("dna"))
    return s.select("seq_id", text.whole_codons(F.col("dna")).alias("whole"), S.translate(F.col("dna")).alias("protein"), text.bad_cds(F.col("dna")).alias("bad"))


_TWIN_SQL = f"""s AS (SELECT p_partkey AS i, p_size AS file, {_DNA.format("p_partkey")} AS dna FROM part), p AS (SELECT *, array_to_string(list_transform(range(0, 10), lambda i: ({R.CODON_MAP})[substr(dna, 3 * i + 1, 3)]), '') AS made FROM s),
  t AS (SELECT i, file, CASE WHEN i % 211 = 7 THEN 'N' || substr(dna, 2) ELSE dna END AS dna, regexp_replace(made, '\\*$', '') AS made,
        CASE WHEN i % 197 = 5 THEN reverse(made) WHEN i % 211 = 7 THEN 'WWW' WHEN i % 13 = 3 THEN substr(made, 3, 6) WHEN i % 13 = 4 THEN 'MK' || regexp_replace(made, '\\*$', '') || 'K' WHEN i % 1999 = 9 THEN '' ELSE made END AS given FROM p),
  u AS (SELECT *, regexp_replace(given, '\\*$', '') AS g FROM t WHERE i % 1801 <> 11)"""


@query(f"""WITH {_TWIN_SQL}, k AS (SELECT s.file, coalesce((contains(u.made, g) AND g <> '') OR (contains(g, u.made) AND u.made <> '') OR u.made = g OR contains(u.dna, 'N'), false) AS same FROM s LEFT JOIN u ON u.i = s.i)
  SELECT file, bool_and(same) AS agree FROM k GROUP BY file""")
def twin_files_agree(spark, d):
    """Files of coding sequences by size, and of proteins: some turned round, cut, longer, empty or missing, some with N."""
    i = F.col("place")
    s = V.table(spark, d, "part").select(F.col("p_size").alias("file"), F.col("p_partkey").alias("place"), _dna(F.col("p_partkey")).alias("dna"))
    made = S.translate(F.col("dna"))
    bare = F.regexp_replace(made, r"\*$", "")
    given = F.when(i % 197 == 5, F.reverse(made)).when(i % 211 == 7, "WWW").when(i % 13 == 3, F.substring(made, 3, 6)).when(i % 13 == 4, F.concat(F.lit("MK"), bare, F.lit("K"))).when(i % 1999 == 9, "").otherwise(made)
    nt = s.select("file", "place", F.when(i % 211 == 7, F.concat(F.lit("N"), F.substring("dna", 2, 40))).otherwise(F.col("dna")).alias("seq"))
    return Q.twins_agree(nt, s.filter(i % 1801 != 11).select("file", "place", given.alias("seq")), "file")


@query(f"""WITH m AS (SELECT l_orderkey AS gene, l_linenumber AS isoform, string_agg({_DNA.format("l_partkey")}, '' ORDER BY l_partkey) AS seq FROM lineitem GROUP BY ALL)
  SELECT gene::VARCHAR AS gene, isoform::VARCHAR AS isoform, length FROM (SELECT *, length(seq) AS length, row_number() OVER (PARTITION BY gene ORDER BY length(seq) DESC, isoform) AS n FROM m) WHERE n = 1""")
def longest_isoforms(spark, d):
    """Isoforms written as FASTA with their gene in the header, read back, one kept a gene."""
    li = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("gene"), F.col("l_linenumber").alias("isoform")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_partkey")), _dna), "").alias("seq"))
    path = _write(sinks.fasta_lines(li.select(F.concat("isoform", F.lit(" pep gene:"), "gene", F.lit(".1 x")).alias("header"), "seq")), "isoforms")
    return Q.longest_per_group(text.isoforms(spark, path).withColumn("seq_id", F.col("isoform").cast("int")), "gene").select("gene", "isoform", "length")


# --- tables -----------------------------------------------------------------------------------------------------------

_HSP_SQL = """hsp AS (SELECT q, s, pident, (bits % 300 + 1)::INT AS alen, (q % 97 + 400)::INT AS qlen, (s % 89 + 400)::INT AS slen, (q % 50 + 1)::INT AS qs, (q % 50 + 300)::INT AS qe, (s % 40 + 1)::INT AS ss, (s % 40 + 300)::INT AS se, evalue, bits FROM hits)"""


def _hsps(spark, d) -> DataFrame:
    x = lambda e, n: F.expr(e).cast("int").alias(n)
    return V.hits(spark, d).select("q", "s", "pident", x("bits % 300 + 1", "alen"), x("q % 97 + 400", "qlen"), x("s % 89 + 400", "slen"), x("q % 50 + 1", "qs"), x("q % 50 + 300", "qe"), x("s % 40 + 1", "ss"), x("s % 40 + 300", "se"), "evalue", "bits")


@query(f"WITH {V.HITS_SQL}, {_HSP_SQL} SELECT * FROM hsp")
def hsp_table(spark, d):
    """All hits as an aligner's table, written in compressed parts and read back."""
    return text.hsps(spark, _tsv(_hsps(spark, d), "hsps", compression="snappy"))


@query(f"""WITH {V.HITS_SQL}, {_HSP_SQL} SELECT q, s, evalue, pident, qcov::INT AS qcov, scov::INT AS scov, qlen, slen, 1 AS h, qs, qe, ss, se, bits FROM hsp JOIN (SELECT q, s, qcov, scov FROM hits) USING (q, s)
  UNION ALL SELECT q, s, evalue, pident, qcov::INT, scov::INT, qlen, slen, 2, qe + 5, qe + 20, se + 1, se + 9, bits FROM hsp JOIN (SELECT q, s, qcov, scov FROM hits) USING (q, s)""")
def folded_hit_table(spark, d):
    """Folded hits with two segments each, written as compressed text, read and their spans parsed."""
    h = V.hits(spark, d)
    x = lambda e: F.expr(e).cast("int")
    qe, se = x("q % 50 + 300"), x("s % 40 + 300")
    part = lambda h, a, b, c, e: F.concat(F.lit(f"{h}:"), a, F.lit("-"), b, F.lit(":"), c, F.lit("-"), e, F.lit("."))
    span = F.concat(part(1, x("q % 50 + 1"), qe, x("s % 40 + 1"), se), part(2, qe + 5, qe + 20, se + 1, se + 9))
    rows = h.select("q", "s", "evalue", "pident", F.col("qcov").cast("int"), F.col("scov").cast("int"), x("q % 97 + 400").alias("qlen"), x("s % 89 + 400").alias("slen"), span.alias("simspan"), "bits")
    back = text.bpo(spark, _tsv(rows, "bpo", compression="gzip"))
    return back.select(*[c for c in back.columns if c != "simspan"], F.explode(I.parse_simspan(F.col("simspan"))).alias("x")).select("q", "s", "evalue", "pident", "qcov", "scov", "qlen", "slen", "x.*", "bits")


@query(f"WITH {V.HITS_SQL} SELECT tq, ts, count(*) AS n, sum(bits)::BIGINT AS bits FROM hits GROUP BY ALL")
def hits_by_query_taxon(spark, d):
    """Hits stored in a folder a query taxon; every taxon's folder is read by a filter on the partition."""
    path = _folder(spark, "taxa")
    text.store_hits(V.hits(spark, d), path)
    taxa = [r[0] for r in V.table(spark, d, "part").select("p_brand").distinct().collect()]  # one row a taxon
    return text.stored_hits(spark, path, taxa).groupBy("tq", "ts").agg(F.count(F.lit(1)).alias("n"), F.sum("bits").cast("long").alias("bits"))


@query("SELECT p_partkey AS seq_id, p_brand AS taxon, p_name || ', #' || p_size AS header FROM part")
def id_table(spark, d):
    p = V.table(spark, d, "part").select(F.concat_ws(",", "p_partkey", "p_brand", F.concat("p_name", F.lit(", hash"), "p_size")).alias("value"))
    return text.ids(spark, _write(p, "ids"))


@query("""WITH m AS (SELECT l_orderkey AS seq_id, list(DISTINCT 'PF' || l_partkey % 50 ORDER BY 'PF' || l_partkey % 50) AS x FROM lineitem GROUP BY ALL) SELECT seq_id, unnest(x) AS domain FROM m""")
def domain_table(spark, d):
    li = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq_id")).agg(F.sort_array(F.collect_set(F.concat(F.lit("PF"), F.col("l_partkey") % 50))).alias("x"))
    line = li.select("seq_id", F.concat(F.array_join("x", ","), F.lit(",")).alias("d"), F.concat(F.array_join("x", ";"), F.lit(";")).alias("t"))
    return text.domains(spark, _tsv(line, "domains")).select("seq_id", F.explode("domains").alias("domain"))


_REPORT_SQL = """hit AS (SELECT l_orderkey AS seq_id, 'PF' || l_partkey % 40 AS name, 'family ' || l_partkey % 40 AS descr, ('1e-' || l_linenumber)::DOUBLE AS evalue, l_quantity::INT * 3 AS "start", l_quantity::INT * 3 + 20 + l_linenumber AS "end" FROM lineitem)"""


def _report(spark, d) -> str:
    """Orders as queries and their lines as domain hits, in the lines of a domain search report; 16 files."""
    li = V.table(spark, d, "lineitem")
    start = F.col("l_quantity").cast("int") * 3
    hit = F.concat(F.lit(">> PF"), F.col("l_partkey") % 40, F.lit(".7  family "), F.col("l_partkey") % 40, F.lit("\n   1 !   10.0   0.1   1e-99   1e-"), "l_linenumber", F.lit("   1   20 [.   "), start, F.lit("   "), start + 20 + F.col("l_linenumber"), F.lit(" ..   1   20 .. 0.90"))
    per = li.select("l_orderkey", hit.alias("h")).groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("h")), "\n").alias("h"))
    lines = per.select((F.col("l_orderkey") % 16).alias("file"), F.col("l_orderkey").alias("ord"), F.concat(F.lit("Query:       "), "l_orderkey", F.lit("  [L=200]\n"), "h", F.lit("\n//")).alias("value"))
    none = V.table(spark, d, "part").select((F.col("p_partkey") % 16).alias("file"), (-F.col("p_partkey")).alias("ord"), F.concat(F.lit("Query:       "), F.col("p_partkey") + 1_000_000_000, F.lit("  [L=9]\n   [No hits detected that satisfy reporting thresholds]\n//")).alias("value"))
    return sinks.write_reports(lines.unionByName(none), _folder(spark, "report"))


@query(f"""WITH {_REPORT_SQL} SELECT seq_id, name, descr, evalue, "start", "end" FROM hit UNION ALL SELECT p_partkey + 1000000000, NULL, NULL, NULL, NULL, NULL FROM part""")
def domain_report(spark, d):
    return text.hmmer(spark, _report(spark, d))


@query(f"""WITH RECURSIVE {_REPORT_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY evalue, "start", "end", name, descr) AS i FROM hit),
  f AS (SELECT seq_id, i, [{{'a': "start", 'n': name, 'b': "end"}}] AS kept FROM g WHERE i = 1 UNION ALL
    SELECT g.seq_id, g.i, CASE WHEN len(list_filter(kept, lambda k: (g."start" + g."end") / 2.0::DOUBLE > k.a AND (g."start" + g."end") / 2.0::DOUBLE < k.b)) > 0 THEN kept ELSE list_append(kept, {{'a': g."start", 'n': g.name, 'b': g."end"}}) END
    FROM f JOIN g ON g.seq_id = f.seq_id AND g.i = f.i + 1)
  SELECT seq_id, array_to_string(list_transform(list_sort(list_transform(kept, lambda k: {{'a': k.a, 'n': k.n}})), lambda k: k.n), ',') AS domains FROM (SELECT *, max(i) OVER (PARTITION BY seq_id) AS top FROM f) WHERE i = top""")
def chosen_domains(spark, d):
    hits = text.hmmer(spark, _report(spark, d)).filter("name IS NOT NULL")
    return I.choose_domains(hits).select("seq_id", F.array_join("domains", ",").alias("domains"))


@query(f"WITH {_C} SELECT DISTINCT cluster_id AS cluster, seq_id FROM clusters")
def cluster_matrix_file(spark, d):
    """Clusters in the lines of a clustering program's matrix, members wrapped over lines."""
    c = V.order_clusters(spark, d).groupBy("cluster_id").agg(F.sort_array(F.collect_set("seq_id")).alias("m"))
    line = c.select((F.col("cluster_id") % 16).alias("file"), F.col("cluster_id").alias("ord"), F.concat("cluster_id", F.lit("      "), F.array_join(F.transform("m", lambda x: x.cast("string")), "\n        "), F.lit(" $")).alias("value"))
    heads = line.select("file").distinct()
    lines = line.unionByName(heads.select("file", F.lit(-1).cast("long").alias("ord"), F.lit("(mclheader\nmcltype matrix\n)\n(mclmatrix\nbegin\n").alias("value"))).unionByName(heads.select("file", F.lit(1 << 60).alias("ord"), F.lit(")").alias("value")))
    return text.mcl_clusters(spark, sinks.write_reports(lines, _folder(spark, "mcl")))


def _one(lines: DataFrame) -> DataFrame:
    """lines(ord, value) as one report."""
    return lines.select(F.lit("a").alias("file"), "ord", "value")


@query(f"""WITH {V.PAN_SQL}, c AS (SELECT DISTINCT cluster FROM pan), t AS (SELECT DISTINCT taxon FROM pan)
  SELECT t.taxon::VARCHAR AS taxon, c.cluster::VARCHAR AS cluster, coalesce(n, 0) AS n FROM t, c LEFT JOIN pan ON pan.taxon = t.taxon AND pan.cluster = c.cluster""")
def matrix_file(spark, d):
    lines = sinks.matrix_lines(V.pangenome(spark, d), "tables")
    return text.drop_separators(text.matrix(spark, sinks.write_reports(_one(lines), _folder(spark, "matrix"))))


_GENES_SQL = """gen AS (SELECT DISTINCT month(l_shipdate) AS taxon, 'c' || l_partkey AS cluster, 'g' || l_suppkey AS gene FROM lineitem)"""


@query(f"WITH {_GENES_SQL} SELECT taxon::VARCHAR AS taxon, cluster, gene FROM gen")
def gene_matrix_file(spark, d):
    li = V.table(spark, d, "lineitem").select(F.month("l_shipdate").alias("taxon"), F.concat(F.lit("c"), "l_partkey").alias("cluster"), F.concat(F.lit("g"), "l_suppkey").alias("gene")).distinct()
    back = text.gene_matrix(spark, sinks.write_reports(_one(sinks.gene_lines(li, "tables")), _folder(spark, "genes")))
    return back.select("taxon", "cluster", F.explode("genes").alias("gene"))


@query("""WITH m AS (SELECT l_orderkey AS o, 'T' || l_suppkey % 9 || '.gbk' AS taxon, l_linenumber AS place FROM lineitem)
  SELECT 'c' || o AS name, count(*) OVER (PARTITION BY o)::INT AS size, k::INT AS taxa, CASE WHEN o % 3 = 0 THEN 'PF' || o % 7 END AS domain, o || '.faa' AS file, CASE WHEN o % 2 = 0 THEN o || '.fna' END AS dnafile, taxon
  FROM m JOIN (SELECT o, count(DISTINCT taxon) AS k FROM m GROUP BY o) USING (o)""")
def cluster_list_file(spark, d):
    o = F.col("l_orderkey")
    m = V.table(spark, d, "lineitem").select(
        (o % 16).alias("part"), o.alias("ord"), F.concat(F.lit("c"), o).alias("name"), F.concat(F.lit("T"), F.col("l_suppkey") % 9, F.lit(".gbk")).alias("taxon"), F.when(o % 3 == 0, F.array(F.concat(F.lit("PF"), o % 7))).otherwise(F.array().cast("array<string>")).alias("domains"),
        F.concat(o, F.lit(".faa")).alias("file"), F.when(o % 2 == 0, F.concat(o, F.lit(".fna"))).alias("dnafile"), F.struct("l_linenumber", "l_partkey").alias("place"))
    key = F.regexp_extract("name", r"(\d+)", 1).cast("long")
    lines = sinks.cluster_list_lines(m).select((key % 16).alias("file"), key.alias("ord"), "value")
    back = text.cluster_list(spark, sinks.write_reports(lines, _folder(spark, "lists")))
    return back.select("name", "size", "taxa", F.get("domains", F.lit(0)).alias("domain"), "file", "dnafile", "taxon")


@query(f"WITH {R._GROWTH_SQL} SELECT sample::INT AS sample, g::INT AS g, sum(new) OVER (PARTITION BY sample ORDER BY g)::BIGINT AS n FROM base")
def growth_file(spark, d):
    pan = V.pangenome(spark, d)
    lines = sinks.growth_lines(GR.growth(pan, R._orders(pan)), "pan")
    back = text.growth_table(spark, sinks.write_reports(_one(lines), _folder(spark, "growth")))
    return back.select(F.col("sample").cast("int").alias("sample"), F.col("g").cast("int").alias("g"), "n")


_HOM = "identity, goc_score, wga_coverage, is_high_confidence"


@query("""SELECT 'g' || l_partkey AS gene_stable_id, 'h' || l_suppkey AS homology_gene_stable_id, l_quantity::DOUBLE AS identity, l_linenumber * 20.0::DOUBLE AS goc_score FROM lineitem
  WHERE l_linenumber <> 3 AND l_linenumber * 20 >= 50 AND l_quantity >= 20 AND l_quantity::INT % 2 = 1""")
def homology_thresholds(spark, d):
    """Homologies with literal NULLs, read back with thresholds that a null fails."""
    n = lambda k: F.lit(None).cast(k)
    q = F.col("l_quantity")
    li = V.table(spark, d, "lineitem").select(
        F.concat(F.lit("g"), "l_partkey").alias("gene_stable_id"), F.lit("p").alias("protein_stable_id"), F.lit("a").alias("species"), q.alias("identity"), F.lit("ortholog").alias("homology_type"), F.concat(F.lit("h"), "l_suppkey").alias("homology_gene_stable_id"),
        F.lit("hp").alias("homology_protein_stable_id"), F.lit("b").alias("homology_species"), q.alias("homology_identity"), n("double").alias("dn"), n("double").alias("ds"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") * 20.0).alias("goc_score"), q.alias("wga_coverage"), (q.cast("int") % 2).alias("is_high_confidence"))
    back = text.homologies(spark, _tsv(li, "homologies", header=True), min_goc=50, min_wga=20, high_confidence=True)
    return back.select("gene_stable_id", "homology_gene_stable_id", "identity", "goc_score")


@query("""SELECT 'g' || l_orderkey || '_' || l_linenumber AS gene, 'chr' || l_suppkey AS chr, l_partkey::INT AS "start", (l_partkey + l_quantity)::INT AS "end", CASE WHEN l_quantity > 25 THEN -1 ELSE 1 END AS strand FROM lineitem""")
def gene_coordinates(spark, d):
    li = V.table(spark, d, "lineitem")
    strand = F.when(F.col("l_quantity") > 25, "-").otherwise("+")
    kinds = F.explode(F.array(F.lit("gene"), F.lit("exon")))
    row = li.select(F.concat(F.lit("chr"), "l_suppkey").alias("c"), F.lit("x").alias("s"), kinds.alias("f"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("b"), F.lit(".").alias("p"), strand.alias("t"), F.lit(".").alias("r"),
                    F.concat(F.lit('biotype "y"; gene_id "g'), "l_orderkey", F.lit("_"), "l_linenumber", F.lit('"; z "1"')).alias("n"))
    return text.gtf_genes(spark, _write(row.select(F.concat_ws("\t", *row.columns).alias("value")), "gtf"))


# --- GenBank ----------------------------------------------------------------------------------------------------------

_GB_SQL = f"""li AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r, l_partkey AS p, l_quantity::INT % 6 AS f FROM lineitem),
con AS (SELECT o, string_agg({_DNA.format("(o || '/' || r)")}, '' ORDER BY r) AS dna FROM li GROUP BY o),
fea AS (SELECT *, 32 * (r - 1) + 1 AS a, 32 * (r - 1) + 30 AS b FROM li),
rc AS (SELECT fea.*, lower(dna) AS dna, substr(lower(dna), a, 30) AS one, substr(lower(dna), a, 9) || substr(lower(dna), a + 12, 18) AS two FROM fea JOIN con USING (o)),
gb AS (SELECT o, r, p, f, a, b, 'o' || o AS contig, length(dna)::INT AS size, CASE WHEN f IN (1, 3, 5) THEN -1 ELSE 1 END AS strand,
  CASE f WHEN 0 THEN one WHEN 1 THEN reverse(translate(one, 'acgt', 'tgca')) WHEN 2 THEN two WHEN 3 THEN reverse(translate(two, 'acgt', 'tgca'))
    WHEN 4 THEN substr(dna, a, 9) || reverse(translate(substr(dna, a + 12, 18), 'acgt', 'tgca')) ELSE reverse(translate(two, 'acgt', 'tgca')) END AS dna FROM rc)"""


def _genbank(spark, d) -> str:
    """Orders as contigs of 32 bases a line, lines as features in six forms of location; compressed files of many records.

    Lines are dealt by their contig once, and tables of features, sequences and the records made of both keep to that.
    """
    li = V.table(spark, d, "lineitem").withColumn("contig", F.concat(F.lit("o"), "l_orderkey"))
    w = W.partitionBy("contig").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = li.select("contig", F.substring("contig", 2, 20).alias("o"), F.row_number().over(w).alias("r"), F.col("l_partkey").alias("p"), (F.col("l_quantity").cast("int") % 6).alias("f"))
    a = 32 * (F.col("r") - 1) + 1
    one, two = F.concat(a, F.lit(".."), a + 29), F.concat(a, F.lit(".."), a + 8, F.lit(","), a + 12, F.lit(".."), a + 29)
    wrap = lambda head, x: F.concat(F.lit(f"{head}("), x, F.lit(")"))
    second, first = F.concat(a + 12, F.lit("..>"), a + 29), F.concat(F.lit("<"), a, F.lit(".."), a + 8)
    place = (F.when(F.col("f") == 0, one).when(F.col("f") == 1, wrap("complement", one)).when(F.col("f") == 2, wrap("join", two)).when(F.col("f") == 3, wrap("complement", wrap("join", two)))
             .when(F.col("f") == 4, wrap("join", F.concat(first, F.lit(","), wrap("complement", second)))).otherwise(wrap("join", F.concat(wrap("complement", second), F.lit(","), wrap("complement", first)))))
    kind = F.when(F.col("p") % 5 == 0, "gene").otherwise("CDS")
    qual = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    quals = F.array(qual("locus_tag", F.concat(F.lit("L"), "o", F.lit("_"), "r")), qual("product", F.concat(F.lit("part "), "p")))
    features = rows.select("contig", F.col("r").alias("ord"), kind.alias("type"), place.alias("place"), quals.alias("quals"))
    dna = F.transform(F.sequence(F.lit(1), F.max("r")), lambda r: _dna(F.concat(F.substring("contig", 2, 20), F.lit("/"), r)))
    contigs = rows.groupBy("contig").agg(F.array_join(dna, "").alias("dna")).select("contig", F.lit("Ordo ordo").alias("organism"), "dna")
    return sinks.write_records(sinks.genbank_lines(features, contigs), _folder(spark, "genbank"))


@query(f"WITH {_GB_SQL} SELECT contig, size, CASE WHEN p % 5 = 0 THEN 'gene' ELSE 'CDS' END AS type, a::INT AS \"start\", b::INT AS \"end\", strand, dna, 'part ' || p AS product FROM gb")
def genbank_features(spark, d):
    return genbank.features(spark, _genbank(spark, d)).select("contig", "size", "type", "start", "end", "strand", "dna", F.col("quals")["product"].alias("product"))


@query(f"""WITH {_GB_SQL}, t AS (SELECT *, 'L' || o || '_' || r AS id, array_to_string(list_transform(range(0, length(dna) // 3), lambda i: ({R.CODON_MAP})[upper(substr(dna, 3 * i + 1, 3))]), '') AS aa FROM gb WHERE p % 5 <> 0)
  SELECT contig, id, CASE WHEN aa LIKE '%*' THEN substr(aa, 1, length(aa) - 1) ELSE aa END AS protein, lag(id) OVER w AS left_id, lead(id) OVER w AS right_id FROM t WINDOW w AS (PARTITION BY o ORDER BY a)""")
def genbank_coding_sequences(spark, d):
    return genbank.coding(spark, _genbank(spark, d)).select("contig", "id", "protein", "left_id", "right_id")


@query(f"""WITH {_GB_SQL}, t AS (SELECT *, array_to_string(list_transform(range(0, length(dna) // 3), lambda i: ({R.CODON_MAP})[upper(substr(dna, 3 * i + 1, 3))]), '') AS aa FROM gb WHERE p % 5 = 0),
  u AS (SELECT *, CASE WHEN aa LIKE '%*' THEN substr(aa, 1, length(aa) - 1) ELSE aa END AS protein FROM t) SELECT contig, 'L' || o || '_' || r AS id, protein FROM u WHERE NOT regexp_matches(protein, '\\*[A-Za-z]')""")
def genbank_genes(spark, d):
    return genbank.genes(spark, _genbank(spark, d)).select("contig", F.col("quals")["locus_tag"].alias("id"), "protein")


@query(f"""WITH {_GB_SQL}, g AS (SELECT o, r, a, b, strand, lead(r) OVER w AS r2, lead(a) OVER w AS a2, lead(b) OVER w AS b2, lead(strand) OVER w AS s2 FROM gb WHERE r % 2 = 1 WINDOW w AS (PARTITION BY o ORDER BY a, r))
  SELECT 'o' || o AS contig, r AS left_id, r2 AS r_id, (a2 - b - 1)::BIGINT AS size, upper(substr(dna, b - 7, 8)) || lower(substr(dna, b + 1, a2 - b - 1)) || upper(substr(dna, a2, 8)) AS seq
  FROM g JOIN con USING (o) WHERE a2 - b - 1 BETWEEN 20 AND 60""")
def intergenic_segments(spark, d):
    found = genbank.features(spark, _genbank(spark, d)).withColumn("seq_id", F.col("ord") + 1)
    li = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    contigs = li.select(F.concat(F.lit("o"), "o").alias("contig"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda r: _dna(F.concat("o", F.lit("/"), r))), "").alias("dna"))
    genes = found.filter("seq_id % 2 = 1").select(F.col("seq_id").cast("long").alias("seq_id"), "contig", "start", "end", "strand")
    return Q.intergenic(genes, contigs, 20, 60, 8).select("contig", "left_id", "r_id", F.col("size").cast("long").alias("size"), "seq")


@query(f"""WITH t AS (SELECT p_partkey AS p, 't' || p_partkey AS id, {_DNA.format("p_partkey")} AS seq FROM part)
  SELECT id, CASE p % 3 WHEN 0 THEN NULL WHEN 1 THEN '+c' || p % 7 || ':' || p || ':' || p + 99 ELSE '-c' || p % 7 || ':' || p || ':' || p + 99 END AS hit, CASE WHEN p % 3 > 0 THEN 101.0::DOUBLE + p % 50 END AS median_intron,
    CASE p % 3 WHEN 0 THEN seq WHEN 1 THEN substr(seq, 1, 10) || substr(seq, 15, 8) ELSE reverse(translate(substr(seq, 1, 10) || substr(seq, 15, 8), 'ACGT', 'TGCA')) END AS seq FROM t""")
def spliced_transcripts(spark, d):
    """Transcripts cut by the exons of a genome mapping report; those without a path come as they are."""
    p = F.col("p_partkey")
    minus = p % 3 == 2
    place = F.when(minus, F.concat(p + 99, F.lit(".."), p)).otherwise(F.concat(p, F.lit(".."), p + 99))
    sign = F.when(minus, "-").otherwise("+")
    chr_ = F.concat(F.lit("c"), p % 7)
    exon = lambda a, b, tail: F.concat(F.lit("    "), sign, chr_, F.lit(":1-2  ("), F.lit(f"{a}-{b}"), F.lit(")   99%"), tail, F.lit("\n"))
    report = F.concat(F.lit(">t"), p, F.lit("\nPaths (1):\n  Path 1: query 1..32 (32 bp) => genome "), chr_, F.lit(":"), place, F.lit(" (100 bp)\n  Alignment for path 1:\n"), exon(1, 10, F.concat(F.lit(" ->   ..."), 101 + p % 50, F.lit("...  0.9"))), exon(15, 22, F.lit("")))
    part = V.table(spark, d, "part")
    lines = part.select((p % 8).alias("file"), p.alias("ord"), F.when(p % 3 == 0, F.concat(F.lit(">t"), p, F.lit("\nPaths (0):\n"))).otherwise(report).alias("value"))
    return text.gmap(spark, sinks.write_reports(lines, _folder(spark, "gmap")), part.select(F.concat(F.lit("t"), p).alias("id"), _dna(p).alias("seq")))


@query(f"""WITH s AS (SELECT p_partkey AS seq_id, {_DNA.format("p_partkey")} || {_DNA.format("p_name")} AS t FROM part), f AS (SELECT seq_id, 1 AS strand, k, substr(t, k) AS x FROM s, unnest([1, 2, 3]) AS u(k) UNION ALL SELECT seq_id, -1, k, substr(reverse(translate(t, 'ACGT', 'TGCA')), k) FROM s, unnest([1, 2, 3]) AS u(k)),
  p AS (SELECT seq_id, strand, k, array_to_string(list_transform(range(0, length(x) // 3), lambda i: ({R.CODON_MAP})[substr(x, 3 * i + 1, 3)]), '') AS aa FROM f),
  q AS (SELECT seq_id, strand, k, w, unnest(w) AS part, generate_subscripts(w, 1) AS i FROM (SELECT *, string_split(aa, '*') AS w FROM p)),
  m AS (SELECT *, strpos(part, 'M') AS met, CASE WHEN i = 1 THEN part WHEN strpos(part, 'M') > 0 THEN substr(part, strpos(part, 'M')) END AS orf FROM q)
  SELECT seq_id, strand, CASE WHEN (i = 1 AND met = 1) OR i > 1 THEN CASE WHEN i < len(w) THEN 'complete' ELSE '3prime' END WHEN i < len(w) THEN '5prime' ELSE 'internal' END AS type, orf AS protein FROM m WHERE orf IS NOT NULL AND length(orf) >= 8""")
def open_reading_frames(spark, d):
    s = V.table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.concat(_dna(F.col("p_partkey")), _dna(F.col("p_name"))).alias("seq"))
    return transcripts.orfs(s, 8).select("seq_id", "strand", "type", "protein")


# --- sinks ------------------------------------------------------------------------------------------------------------

_BITS_SQL = """c AS (SELECT DISTINCT cluster FROM pan), t AS (SELECT DISTINCT taxon FROM pan), f AS (SELECT t.taxon, c.cluster, coalesce(n, 0) AS n FROM t, c LEFT JOIN pan ON pan.taxon = t.taxon AND pan.cluster = c.cluster)"""


@query(f"WITH {V.PAN_SQL}, {_BITS_SQL} SELECT '>' || taxon || chr(10) || string_agg(CASE WHEN n > 0 THEN '1' ELSE '0' END, '' ORDER BY cluster) AS value FROM f GROUP BY taxon")
def binary_fasta_lines(spark, d):
    return sinks.binary_fasta(V.pangenome(spark, d)).select("value")


@query(f"""WITH {V.PAN_SQL}, {_BITS_SQL} SELECT '{",".join(sinks.PRESENCE_COLUMNS)},' || string_agg(taxon, ',' ORDER BY taxon) AS value FROM t UNION ALL
  SELECT cluster || ',,,' || sum((n > 0)::INT) || ',' || sum(n) || ',' || format('{{:.2f}}', sum(n)::DOUBLE / sum((n > 0)::INT)) || ',,,,,,,,,' || string_agg(CASE WHEN n > 0 THEN '1' ELSE '0' END, ',' ORDER BY taxon) FROM f GROUP BY cluster""")
def presence_csv_lines(spark, d):
    return sinks.presence_csv(V.pangenome(spark, d)).select("value")


@query(f"""WITH {_C}, n AS (SELECT DISTINCT seq_id, taxon FROM clusters), t AS (SELECT DISTINCT taxon FROM n), g AS (SELECT DISTINCT cluster_id FROM clusters),
  x AS (SELECT 0 AS section, '' AS taxon, 0 AS cluster, 0 AS step, 0 AS seq, '<?xml version="1.0" encoding="utf-8"?><orthoXML xmlns="http://orthoXML.org/2011/" version="0.3" origin="panweave" originVersion="1">' AS value
    UNION ALL SELECT 1, taxon, 0, 0, 0, '<species name="' || taxon || '"><database name="' || taxon || '"><genes>' FROM t
    UNION ALL SELECT 1, taxon, 0, 1, seq_id, '<gene id="' || seq_id || '" protId="p&amp;' || seq_id || '"/>' FROM n
    UNION ALL SELECT 1, taxon, 0, 2, 0, '</genes></database></species>' FROM t
    UNION ALL SELECT 2, '', 0, 0, 0, '<groups>'
    UNION ALL SELECT 3, '', cluster_id, 0, 0, '<orthologGroup id="' || cluster_id || '">' FROM g
    UNION ALL SELECT 3, '', cluster_id, 1, seq_id, '<geneRef id="' || seq_id || '"/>' FROM clusters
    UNION ALL SELECT 3, '', cluster_id, 2, 0, '</orthologGroup>' FROM g
    UNION ALL SELECT 4, '', 0, 0, 0, '</groups></orthoXML>')
  SELECT row_number() OVER (ORDER BY section, taxon, cluster, step, seq) AS place, value FROM x""")
def ortholog_xml(spark, d):
    c = Tables(spark, "orthologs").save(V.order_clusters(spark, d).withColumn("name", F.concat(F.lit("p&"), "seq_id")))
    return ranked(Tables(spark, "lines"), sinks.orthoxml(c), [], ["ord", "value"], "place").select("place", "value")


@query(f"""WITH s AS (SELECT p_partkey AS i, p_brand AS taxon, {_DNA.format("p_partkey")} AS seq FROM part), t AS (SELECT DISTINCT taxon FROM s)
  SELECT taxon, 0 AS step, 0 AS seq, '<seqXML seqXMLversion="0.4" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:noNamespaceSchemaLocation="http://www.seqxml.org/0.4/seqxml.xsd">' AS value FROM t
  UNION ALL SELECT taxon, 1, i, '<entry id="&lt;' || i || '" source="' || taxon || '"><DNAseq>' || seq || '</DNAseq></entry>' FROM s UNION ALL SELECT taxon, 2, 0, '</seqXML>' FROM t""")
def sequence_xml(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_brand").alias("taxon"), F.concat(F.lit("<"), "p_partkey").alias("name"), _dna(F.col("p_partkey")).alias("seq"))
    return sinks.seqxml(p, "DNAseq").select("taxon", "ord.step", "ord.seq", "value")


@query(f"""WITH {V.PAN_SQL}, t AS (SELECT DISTINCT taxon FROM pan), z AS (SELECT taxon, sum(n) AS total FROM pan GROUP BY ALL),
  v AS (SELECT a.taxon AS t1, b.taxon AS t2, 100.0::DOUBLE * sum(a.n + b.n)::BIGINT / any_value(x.total + y.total)::BIGINT AS pocp FROM pan a JOIN pan b USING (cluster) JOIN z x ON x.taxon = a.taxon JOIN z y ON y.taxon = b.taxon WHERE a.taxon <> b.taxon GROUP BY ALL),
  f AS (SELECT a.taxon AS t1, b.taxon AS t2, CASE WHEN a.taxon = b.taxon THEN 100.0 ELSE pocp END AS p FROM t a, t b LEFT JOIN v ON v.t1 = a.taxon AND v.t2 = b.taxon)
  SELECT 'genomes' || chr(9) || string_agg(taxon, chr(9) ORDER BY taxon) AS value FROM t UNION ALL SELECT t1 || chr(9) || string_agg(coalesce(format('{{:.1f}}', floor(10 * p) / 10), 'NA'), chr(9) ORDER BY t2) FROM f GROUP BY t1""")
def square_matrix_lines(spark, d):
    """Percentages cut to one decimal, so that no engine's rounding shows."""
    pan = V.pangenome(spark, d)
    cells = M.square(M.pocp(pan, pan.groupBy("taxon").agg(F.sum("n").alias("total"))), pan.select("taxon").distinct(), "pocp")
    cut = cells.withColumn("pocp", F.floor(F.col("pocp") * 10) / 10)
    return sinks.square_lines(cut, "pocp", decimals=1).select("value")


@query(f"WITH {V.OCC_SQL} SELECT compartment || '_list.txt' AS file, cluster::VARCHAR AS value FROM comp UNION ALL SELECT 'core_list.txt', cluster::VARCHAR FROM comp WHERE core")
def compartment_lists(spark, d):
    """One list a compartment, written and read back with the names of their folders."""
    comp = M.compartments(V.pangenome(spark, d))
    rows = comp.select(F.concat("compartment", F.lit("_list.txt")).alias("file"), F.col("cluster").cast("string").alias("value")).unionByName(comp.filter("core").select(F.lit("core_list.txt").alias("file"), F.col("cluster").cast("string").alias("value")))
    path = _folder(spark, "compartments")
    sinks.write_reports(rows.withColumn("ord", F.col("value").cast("long")), path)
    return spark.read.text(path).select("file", "value")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS i, 'PF' || l_partkey % 11 AS dom FROM lineitem), e AS (SELECT unnest(['PF1', 'PF4', 'PF7']) AS dom)
  SELECT '>h' || i || ' cluster=' || c || ' domains=' || dom || chr(10) || 'M' || i AS value FROM m SEMI JOIN e USING (dom)""")
def enriched_fasta_lines(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.col("l_partkey").alias("seq_id")).distinct()
    members = li.select("cluster", "seq_id", F.concat(F.lit("h"), "seq_id").alias("header"), F.concat(F.lit("M"), "seq_id").alias("seq"), F.array(F.concat(F.lit("PF"), F.col("seq_id") % 11)).alias("domains"))
    return sinks.enriched_fasta(members, spark.createDataFrame([("PF1",), ("PF4",), ("PF7",)], "domain string")).select("value")


@query(f"""WITH {_C}, m AS (SELECT cluster_id AS c, seq_id AS i, CASE WHEN seq_id % 10 > 0 THEN {_DNA.format("seq_id")} END AS dna FROM clusters), w AS (SELECT c FROM m GROUP BY c HAVING count(*) = count(dna))
  SELECT c || '.faa' AS file, i AS seq_id, '>s' || i || chr(10) || 'MK' || i AS value FROM m UNION ALL SELECT c || '.fna', i, '>s' || i || chr(10) || dna FROM m SEMI JOIN w USING (c)""")
def cluster_fasta_files(spark, d):
    """A cluster has a nucleotide file only if all of its members have nucleotides."""
    i = F.col("seq_id")
    m = V.order_clusters(spark, d).select(F.col("cluster_id").cast("string").alias("name"), "seq_id", F.concat(F.lit("s"), i).alias("header"), F.concat(F.lit("MK"), i).alias("protein"), F.when(i % 10 > 0, _dna(i)).alias("dna"))
    return sinks.cluster_files(m)


@query(f"WITH {_C} SELECT cluster_id, taxon, count(*) AS n FROM clusters GROUP BY ALL")
def clusters_read_from_files(spark, d):
    """Clusters written as a FASTA folder each, read back with their names, and counted by taxon label."""
    c = V.order_clusters(spark, d)
    path = _folder(spark, "clusters")
    bucket = c.select((F.col("cluster_id") % 32).cast("string").alias("name"), F.concat(F.lit("c"), "cluster_id", F.lit(" s"), "seq_id", F.lit(" ["), "taxon", F.lit("]")).alias("header"), F.lit("MK").alias("seq"))
    sinks.write_cluster_fasta(bucket, path)
    found = text.fasta(spark, f"{path}/*").withColumn("taxon", S.taxon_of(F.col("header"), True)).select(F.regexp_extract("header", r"^c(\d+)", 1).cast("long").alias("cluster_id"), F.regexp_extract("header", r" s(\d+)", 1).cast("long").alias("seq_id"), "taxon")
    return C.copy_number(found)

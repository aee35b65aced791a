"""Text sources: FASTA, ordered small reports, and fixed-schema tables.

Files are split by Spark's own readers: tables by line, and reports whose lines depend on those before them by what ends
or begins a record (blocks()), so a state never reaches over a border and one file of any size is many tasks' work. Only
lists of names and growth tables, a line a taxon or a sample, are read one file a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.config import HSPS
from panweave.functions import sequences as S
from panweave.operators.ranks import ranked
from panweave.tables import Tables


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def blocks(spark: SparkSession, path: str | list[str], separator: str, begins: str = "") -> DataFrame:
    """(file, split, row, value): the pieces of files between separators, which the reader finds again in every split.

    file is the whole path; (split, row) orders the pieces of a file. begins: what the separator takes from the beginning
    of a piece; it is given back.
    """
    value = F.regexp_replace("value", "\r", "")
    if begins:
        value = F.when(value.startswith(begins), value).otherwise(F.concat(F.lit(begins), value))
    return spark.read.text(path, lineSep=separator).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), value.alias("value"))


def fasta(spark: SparkSession, path: str | list[str], skip_peptides: bool = False, keep_gaps: bool = False) -> DataFrame:
    """(file, pos, header, seq); compressed files by their extension. Blank and # lines go, case stays.

    Records are split at line ends followed by >, so a > inside a header is harmless. pos orders the records of a file.
    skip_peptides drops records with residues that no nucleotide code has.
    """
    rec = spark.read.text(path, lineSep="\n>").select(base_name(F.col("_metadata.file_path")).alias("file"), F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", "^>", "").alias("v"))
    lines = F.split(F.regexp_replace("v", "\r", ""), "\n")
    body = F.array_join(F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: ~x.startswith("#")), "")
    seq = F.regexp_replace(body, r"\s", "") if keep_gaps else S.clean(body)
    out = rec.select("file", "pos", F.trim(F.get(lines, F.lit(0))).alias("header"), seq.alias("seq")).filter("header <> '' AND NOT header LIKE '#%' AND seq <> ''")
    return out.filter(~F.col("seq").rlike("(?i)[QEIPDFHLV]")) if skip_peptides else out


#: Letters of records that a batch of packed_fasta() holds, about.
RECORDS = 4 << 20


def _packed_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, content) -> (file, pos, header, seq): files are unpacked as streams over Arrow's own bytes, and records
    leave in batches of bounded size, so a task holds what Spark hands it of packed files and a batch."""
    import bz2
    import gzip
    import io

    def rows(name: str, first: int, headers: list[str], bodies: list[str]) -> pa.RecordBatch:
        n = len(headers)
        return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(headers, pa.string()), pa.array(bodies, pa.string())], names=["file", "pos", "header", "seq"])

    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1)):
            raw = pa.BufferReader(content.as_buffer())
            start = content.as_buffer().slice(0, min(3, len(content.as_buffer()))).to_pybytes()
            stream = gzip.GzipFile(fileobj=raw) if start[:2] == b"\x1f\x8b" else bz2.BZ2File(raw) if start == b"BZh" else raw
            headers, bodies, first, held, header, lines = [], [], 0, 0, None, []
            for line in io.TextIOWrapper(stream, encoding="utf-8", errors="replace"):
                if not line.startswith(">"):
                    if not line.startswith("#"):
                        lines.append(line)
                        held += len(line)
                    continue
                if header is not None:
                    headers.append(header)
                    bodies.append("".join(lines))
                if held > RECORDS:
                    yield rows(name.as_py(), first, headers, bodies)
                    first, held, headers, bodies = first + len(headers), 0, [], []
                header, lines = line[1:].strip(), []
                held += len(header)
            if header is not None:
                headers.append(header)
                bodies.append("".join(lines))
            if headers:
                yield rows(name.as_py(), first, headers, bodies)


def packed_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """fasta() for files whose names don't tell that they are compressed: gzip and bzip2 by their first bytes.

    A file of this kind can't be split, so one task reads it as a stream of records. pos orders the records of a file.
    """
    found = spark.read.format("binaryFile").load(path).select(base_name(F.col("path")).alias("file"), "content").mapInArrow(_packed_records, "file string, pos long, header string, seq string")
    return found.withColumn("seq", S.clean(F.col("seq"))).filter("header <> '' AND NOT header LIKE '#%' AND seq <> ''")


def by_taxon(records: DataFrame) -> DataFrame:
    """One file of records with [taxon] headers, split: (taxon, ord, seq_id, header, seq).

    Taxa stand in order of name, records in order of pos inside them, numbered from 1 on through all taxa; a label may be
    one word. Nucleotide sequences are left out.
    """
    own = records.withColumn("taxon", S.taxon_of(F.col("header"), True)).filter(F.col("taxon").isNotNull() & ~S.is_nucleotide(F.col("seq")))
    taxa = own.select("taxon").distinct().select("taxon", F.row_number().over(W.orderBy("taxon")).alias("ord"))  # one row a taxon
    placed = ranked(Tables(records.sparkSession, "taxa"), own, [], ["taxon", "pos", "header"], "seq_id")
    return placed.join(taxa, "taxon").select("taxon", "ord", "seq_id", "header", "seq")


def isoforms(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(gene, isoform, length, seq) of a FASTA whose headers are `isoform ... gene:ID ...`; the version of an id is cut."""
    records = fasta(spark, path)
    gene = F.regexp_extract("header", r"gene:([^\s.]+)", 1)
    return records.filter(gene != "").select(gene.alias("gene"), F.regexp_extract("header", r"^([^\s]+)", 1).alias("isoform"), F.length("seq").cast("long").alias("length"), "seq")


def store_hits(hits: DataFrame, path: str) -> None:
    """Hits in a folder per query taxon, so that a read of some taxa opens those folders alone. Rows are written where they
    are, a file a task and taxon, so no taxon is one task's work and none is moved."""
    hits.write.mode("overwrite").partitionBy("tq").parquet(path)


def stored_hits(spark: SparkSession, path: str, taxa: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.filter(F.col("tq").isin(taxa)) if taxa is not None else rows


def taxa_of(records: DataFrame, single_words: bool = False) -> DataFrame:
    """(taxon, n): the bracketed labels of headers with how many records carry them."""
    return records.withColumn("taxon", S.taxon_of(F.col("header"), single_words)).filter("taxon IS NOT NULL").groupBy("taxon").agg(F.count(F.lit(1)).alias("n"))


def bad_cds(dna: Column) -> Column:
    """In-frame stops before the end."""
    return S.has_internal_stop(S.translate(dna))


def whole_codons(dna: Column) -> Column:
    return F.substr(dna, F.lit(1), (F.length(dna) - F.length(dna) % 3).cast("int"))


def table(spark: SparkSession, path: str, schema: str, header: bool = False, null: str = "") -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, header=header, nullValue=null, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def hsps(spark: SparkSession, path: str) -> DataFrame:
    """Twelve columns: query, subject, identity, length, both lengths, both spans, E-value, bits."""
    return table(spark, path, HSPS)


def bpo(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "q long, s long, evalue double, pident double, qcov int, scov int, qlen int, slen int, simspan string, bits double")


def domains(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, domains array, descr array) from `id \\t A,B, \\t d1;d2;`; lists may be empty."""
    raw = table(spark, path, "seq_id long, d string, t string")
    parts = lambda c, sep: F.filter(F.split(F.coalesce(c, F.lit("")), sep), lambda x: x != "")
    return raw.select("seq_id", parts(F.col("d"), ",").alias("domains"), parts(F.col("t"), ";").alias("descr"))


def ids(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, taxon, header) from `id,taxon,header`: split at the first two commas only."""
    v = F.split("value", ",", 3)
    return spark.read.text(path).filter("value <> ''").select(v[0].cast("long").alias("seq_id"), v[1].alias("taxon"), F.replace(v[2], F.lit("hash"), F.lit("#")).alias("header"))


def names(spark: SparkSession, path: str) -> DataFrame:
    """(ord, taxon): one name a line in file order; # starts a comment."""
    t = _lines(spark, path).filter("NOT value RLIKE '^\\\\s*(#|$)'")
    return t.select(F.row_number().over(W.partitionBy("file").orderBy("line")).alias("ord"), F.trim(F.split("value", r"\s")[0]).alias("taxon"))


def input_order(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(file, ord): stored files keep their order, new ones follow in order of name."""
    new = found.join(stored.select("file"), "file", "left_anti").select("file", F.row_number().over(W.orderBy("file")).alias("k"))
    last = stored.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("m"))
    return stored.select("file", F.col("ord").cast("long").alias("ord")).unionByName(new.crossJoin(F.broadcast(last)).select("file", (F.col("k") + F.col("m")).cast("long").alias("ord")))


def files(spark: SparkSession, path: str, pattern: str, name: str = r"([^/]+)$") -> DataFrame:
    """(file, length): names in a folder that match; contents aren't read. name: the group of a path that is its name; the
    parts that have one name are one file."""
    found = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", name, 1).alias("file"), "length").filter(F.col("file").rlike(pattern))
    return found.groupBy("file").agg(F.sum("length").alias("length"))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): file is the whole path, since two folders may hold files of one name."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("v"))
    return whole.select("file", F.posexplode(F.split("v", "\n")).alias("line", "value"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """Wide pangenome matrix -> (taxon, cluster, n): NA gives null; comment, reference and redundant rows are skipped.

    The first cell is `source:<dir>` or starts with non-redundant; a +N suffix of cluster names is cut.
    """
    return _wide(spark, path, F.when(F.col("cell") != "NA", F.col("cell").cast("long")), "n")


def gene_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Wide gene matrix -> (taxon, cluster, genes): `a,b,` or `-`."""
    parts = F.filter(F.split("cell", ","), lambda x: (x != "") & (x != "-"))
    return _wide(spark, path, parts, "genes")


def _wide(spark: SparkSession, path: str, value: Column, name: str) -> DataFrame:
    lines = blocks(spark, path, "\n").select("file", "value").filter("value <> '' AND NOT value LIKE '#%'")
    rows = lines.select("file", F.split(F.regexp_replace("value", "\t+$", ""), "\t").alias("c"))
    first = F.col("c")[0]
    head = rows.filter(first.rlike("^(source:|non-redundant)")).select("file", F.posexplode("c").alias("i", "cluster")).filter("i > 0")
    head = head.select("file", "i", F.regexp_replace("cluster", r"\+\d+$", "").alias("cluster"))
    body = rows.filter(~first.rlike("^(source:|non-redundant|reference|redundant)"))
    # neither a line nor the header may stand beside each of its cells, which would square its length: names join by place
    cells = body.select("file", first.alias("taxon"), "c").select("file", "taxon", F.posexplode("c").alias("i", "cell")).filter("i > 0")
    return cells.join(head, ["file", "i"]).withColumn("value", value).select("taxon", "cluster", F.col("value").alias(name))


def drop_separators(pan: DataFrame) -> DataFrame:
    """Without the clusters that are NA in any taxon (chromosome separators of external matrices)."""
    return pan.join(pan.filter("n IS NULL").select("cluster").distinct(), "cluster", "left_anti").select(*pan.columns)


def cluster_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, taxa, domains, file, dnafile, taxon, place): one row a member, all dialects of the header line.

    Header lines name one to three files (file, aminofile, pepfile; dnafile, cdsfile); members follow as `: taxon`. place
    (split, row, line) orders the lines of a file. A cluster is a piece; comments and blank lines go.
    """
    own = blocks(spark, path, "\ncluster ", "cluster ").select("split", "row", F.split("value", "\n").alias("lines"))
    t = own.select("split", "row", F.get("lines", F.lit(0)).alias("value"), "lines").filter(F.col("value").rlike(r"^cluster \S+ .*="))
    get = lambda p: F.when(F.col("value").rlike(p), F.regexp_extract("value", p, 1))
    amino = F.coalesce(get(r"aminofile: (\S+)"), get(r"pepfile: (\S+)"), F.when(~F.col("value").contains("aminofile:"), get(r"(?<![a-z])file: (\S+)")))
    dna = F.coalesce(get(r"(?<![a-z])dnafile: (\S+)"), get(r"cdsfile: (\S+)"), F.when(F.col("value").contains("aminofile:"), get(r"(?<![a-z])file: (\S+)")))
    head = t.select(
        F.regexp_extract("value", r"^cluster (\S+)", 1).alias("name"), F.regexp_extract("value", r"size=(\d+)", 1).try_cast("int").alias("size"), F.regexp_extract("value", r"taxa=(\d+)", 1).try_cast("int").alias("taxa"),
        F.filter(F.split(F.coalesce(get(r"Pfam=(\S+)"), F.lit("")), ","), lambda x: x != "").alias("domains"), F.nullif(amino, F.lit("void")).alias("file"), F.nullif(dna, F.lit("void")).alias("dnafile"), "split", "row", F.posexplode("lines").alias("n", "line"))
    return head.filter("line LIKE ': %'").select("name", "size", "taxa", "domains", "file", "dnafile", F.regexp_extract("line", r"^: (\S+)", 1).alias("taxon"), F.struct("split", "row", F.col("n").alias("line")).alias("place"))


def mcl_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, seq_id) from the native cluster format: lines may continue, `$` ends a cluster, `)` the list.

    What stands before `begin` (header, domains) is left out. A cluster is a piece.
    """
    flat = F.trim(F.regexp_replace("value", r"\s+", " "))
    own = blocks(spark, path, "$").select(flat.alias("v")).select(F.when(F.col("v").rlike(r"\bbegin\b"), F.regexp_replace("v", r"^.*\bbegin ?", "")).otherwise(F.col("v")).alias("v"))
    rows = own.filter(F.col("v").rlike(r"^\d+ \d")).select(F.split("v", " ").alias("x"))
    return rows.select(F.get("x", F.lit(0)).cast("long").alias("cluster"), F.explode(F.slice("x", 2, F.size("x") - 1)).alias("seq_id")).withColumn("seq_id", F.col("seq_id").cast("long"))


def growth_table(spark: SparkSession, path: str) -> DataFrame:
    """(sample, g, n) from `g1 g2 ...` and one row a sample; g from 0."""
    t = _lines(spark, path).filter("value <> '' AND NOT value LIKE '#%' AND NOT value LIKE 'g1%'").withColumn("sample", F.row_number().over(W.partitionBy("file").orderBy("line")) - 1)
    return t.select("sample", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("g", "n")).withColumn("n", F.col("n").cast("long"))


def rates(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "omega double, pairs int, n_of_seqs int, file string", header=True)


HOMOLOGIES = ("gene_stable_id string, protein_stable_id string, species string, identity double, homology_type string, homology_gene_stable_id string, homology_protein_stable_id string, "
              "homology_species string, homology_identity double, dn double, ds double, goc_score double, wga_coverage double, is_high_confidence int")


def homologies(spark: SparkSession, path: str, min_goc: float | None = None, min_wga: float | None = None, high_confidence: bool = False) -> DataFrame:
    """Fourteen-column homology table; NULL literals are nulls, and a null fails every threshold."""
    t = table(spark, path, HOMOLOGIES, header=True, null="NULL")
    for column, least in (("goc_score", min_goc), ("wga_coverage", min_wga), ("is_high_confidence", 1 if high_confidence else None)):
        if least is not None:
            t = t.filter(F.col(column) >= least)
    return t


def gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    t = table(spark, path, "chr string, source string, feature string, start int, end int, score string, strand string, frame string, attributes string").filter("feature = 'gene'")
    return t.select(F.regexp_extract("attributes", r'gene_id "([^"]+)"', 1).alias("gene"), "chr", "start", "end", F.when(F.col("strand") == "-", -1).otherwise(1).alias("strand"))


def _domains(report: str) -> Iterator[tuple]:
    """Domains of a piece of a report: the query and the family are states that later lines refer to."""
    query, name, descr = None, None, None
    for line in report.split("\n"):
        if m := re.match(r"Query(?: sequence)?:\s+(\d+)", line):
            query, name, descr = int(m[1]), "", ""
        elif line.startswith("Query"):
            name, descr = "", ""
        elif line.startswith(">> "):
            m = re.match(r">> (\S+)(?:\s+(.*))?$", line)
            name, descr = (re.match(r"\w*", m[1])[0], (m[2] or "").strip()) if m else ("", "")
        elif re.match(r"\s+\d+\s+[!?]\s+", line):
            x = line.split()
            yield query, name, descr, float(x[5]), int(x[9]), int(x[10])
        elif "No hits detected that satisfy" in line or "no hits above thresholds" in line:
            yield query, None, None, None, None, None


def hmmer(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(seq_id, name, descr, evalue, start, end) of the domains in hmmscan reports; one row with nulls for no hits.

    `//` ends a query; every query is a piece of its own, with its own states; for choose_domains().
    """
    schema = "seq_id long, name string, descr string, evalue double, start int, end int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = pd.DataFrame([r for v in part["value"] for r in _domains(v)], columns=["seq_id", "name", "descr", "evalue", "start", "end"])
            yield rows.astype({"seq_id": "Int64", "start": "Int32", "end": "Int32", "evalue": "float64"})

    found = blocks(spark, path, "\n//").select("value").mapInPandas(run, schema)
    return found.withColumn("evalue", F.nanvl("evalue", F.lit(None).cast("double")))


def gmap(spark: SparkSession, path: str, transcripts: DataFrame) -> DataFrame:
    """Spliced coding sequences from a genome mapping report: (id, hit, median_intron, seq).

    transcripts(id, seq). Exons are cut from the transcript by the coordinates in the report, turned on the - strand;
    transcripts without a path come through as they are. A transcript's part of the report is a piece.
    """
    schema = "id string, hit string, strand string, exons array<struct<a:int,b:int>>, introns array<int>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part["value"]:
                row = None
                for line in text.splitlines():
                    if m := re.match(r">(\S+)", line):
                        row = [m[1], None, None, [], []]
                        rows.append(row)
                    elif row is None:
                        continue
                    elif (m := re.match(r"  Path \d+: query \S+ \(\S+ bp\) => genome (\S+?):(\S+?)\.\.(\S+)", line)) and row[1] is None:
                        a, b = (int(v.replace(",", "")) for v in m.groups()[1:])
                        row[1:3] = f"{'-' if a > b else '+'}{m[1]}:{min(a, b)}:{max(a, b)}", "-" if a > b else "+"
                    elif m := re.match(r"  Alignment for path (\d+):", line):
                        row.append(int(m[1]) == 1) if len(row) == 5 else row.__setitem__(5, int(m[1]) == 1)
                    elif (m := re.match(r"    [+-]\S+?:\d+-\d+  \((\d+)-(\d+)\)\s+\S+(?:\s+\S+\s+\.\.\.(\d+)\.\.\.)?", line)) and (len(row) == 5 or row[5]):
                        row[3].append({"a": int(m[1]), "b": int(m[2])})
                        if m[3]:
                            row[4].append(int(m[3]))
            yield pd.DataFrame([r[:5] for r in rows], columns=["id", "hit", "strand", "exons", "introns"])

    found = blocks(spark, path, "\n>", ">").select("value").mapInPandas(run, schema).filter("hit IS NOT NULL")
    joined = transcripts.join(found, "id", "left")
    pieces = F.transform("exons", lambda e: F.substr("seq", e["a"], e["b"] - e["a"] + 1))
    forward = F.array_join(pieces, "")
    spliced = F.when(F.col("strand") == "-", S.reverse_complement(forward)).otherwise(forward)
    sorted_introns = F.array_sort("introns")
    n = F.size("introns")
    at = lambda k: F.get(sorted_introns, k.cast("int"))
    median = F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)
    return joined.select("id", "hit", median.alias("median_intron"), F.coalesce(F.when(F.size("exons") > 0, spliced), F.col("seq")).alias("seq"))

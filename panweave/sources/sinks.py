"""Sinks: wide tables, FASTA, cluster lists, PHYLIP, CSV, XML. Only here does the long form become wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.operators.matrix import positions, row_texts


def wide(pan: DataFrame, clusters: list[str]) -> DataFrame:
    """taxon x clusters with 0 for absent; the column list is given, so no extra job finds it."""
    return pan.groupBy("taxon").pivot("cluster", clusters).agg(F.first("n")).na.fill(0).select("taxon", *[F.col(f"`{c}`") for c in clusters])


def _ordered(key: str, item: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), item.alias("v")))), lambda x: x["v"]), sep)


def _heading(places: DataFrame, col: str, sep: str) -> Column:
    return _ordered("pos", F.col(col).cast("string"), sep)


def matrix_lines(pan: DataFrame, source: str, transposed: bool = False) -> DataFrame:
    """(ord, value): lines of the tab-separated matrix, the header first; built as text, so columns need no schema."""
    row, col = ("cluster", "taxon") if transposed else ("taxon", "cluster")
    cells, places = pan.groupBy("taxon", "cluster").agg(F.sum("n").alias("n")), positions(pan, col)
    head = places.agg(F.concat(F.lit(f"source:{source}\t"), _heading(places, col, "\t")).alias("value")).select(F.lit(0).cast("long").alias("ord"), "value")
    body = row_texts(cells, row, col, F.col("n").cast("string"), "0", "\t", places).join(positions(pan, row), row)
    return head.unionByName(body.select((F.col("pos") + 1).alias("ord"), F.concat_ws("\t", row, "text").alias("value")))


def gene_lines(genes: DataFrame, source: str) -> DataFrame:
    """genes(taxon, cluster, gene): cells `a,b,` or `-`."""
    cells = genes.groupBy("taxon", "cluster").agg(F.concat(F.array_join(F.sort_array(F.collect_list("gene")), ","), F.lit(",")).alias("cell"))
    places = positions(genes, "cluster")
    head = places.agg(F.concat(F.lit(f"source:{source}\t"), _heading(places, "cluster", "\t")).alias("value")).select(F.lit(0).cast("long").alias("ord"), "value")
    body = row_texts(cells, "taxon", "cluster", F.col("cell"), "-", "\t", places).join(positions(genes, "taxon"), "taxon")
    return head.unionByName(body.select((F.col("pos") + 1).alias("ord"), F.concat_ws("\t", "taxon", "text").alias("value")))


def _bits(pan: DataFrame, row: str = "taxon", col: str = "cluster", sep: str = "") -> DataFrame:
    """(row, pos, text): presence as 0/1 and the row's place."""
    cells = pan.groupBy("taxon", "cluster").agg(F.sum("n").alias("n"))
    return row_texts(cells, row, col, F.when(F.col("n") > 0, "1").otherwise("0"), "0", sep, positions(pan, col)).join(positions(pan, row), row)


def phylip_lines(pan: DataFrame) -> DataFrame:
    """Discrete PHYLIP: counts in fixed width, then ten-digit numbers for names and 0/1 characters."""
    size = pan.agg(F.count_distinct("taxon").alias("t"), F.count_distinct("cluster").alias("c")).select(F.lit(0).cast("long").alias("ord"), F.format_string("%10d %6d", "t", "c").alias("value"))
    return size.unionByName(_bits(pan).select((F.col("pos") + 1).alias("ord"), F.concat(F.format_string("%010d", "pos"), F.lit("    "), "text").alias("value")))


def binary_fasta(pan: DataFrame) -> DataFrame:
    return _bits(pan).select((F.col("pos") + 1).alias("ord"), F.concat(F.lit(">"), F.col("taxon").cast("string"), F.lit("\n"), "text").alias("value"))


# The leading columns of the gene-presence table.
PRESENCE_COLUMNS = ("Gene", "Non-unique Gene name", "Annotation", "No. isolates", "No. sequences", "Avg sequences per isolate", "Genome Fragment", "Order within Fragment", "Accessory Fragment", "Accessory Order with Fragment", "QC", "Min group size nuc", "Max group size nuc", "Avg group size nuc")


def presence_csv(pan: DataFrame) -> DataFrame:
    """Fourteen fixed columns, then 0/1 for every taxon, as CSV lines."""
    places = positions(pan, "taxon")
    head = places.agg(_heading(places, "taxon", ",").alias("t")).select(F.lit(0).cast("long").alias("ord"), F.concat(F.lit(",".join(PRESENCE_COLUMNS) + ","), "t").alias("value"))
    counts = pan.groupBy("cluster").agg(F.count_distinct(F.when(F.col("n") > 0, F.col("taxon"))).alias("iso"), F.sum("n").alias("seqs"))
    mean = F.format_string("%.2f", F.bround(F.col("seqs") / F.col("iso"), 2))
    line = F.concat_ws(",", F.col("cluster").cast("string"), F.lit(""), F.lit(""), "iso", "seqs", mean, F.lit(",,,,,,,"), "text")
    body = _bits(pan, "cluster", "taxon", ",").join(counts, "cluster")
    return head.unionByName(body.select((F.col("pos") + 1).alias("ord"), line.alias("value")))


def cluster_list_lines(clusters: DataFrame) -> DataFrame:
    """clusters(name, taxon, domains, file, dnafile, place): a header line and `: taxon` per member, as one text a cluster."""
    g = clusters.groupBy("name", "file", "dnafile").agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct("taxon").alias("taxa"), F.first("domains").alias("domains"), _ordered("place", F.concat(F.lit(": "), "taxon"), "\n").alias("members"))
    pfam = F.when(F.size("domains") > 0, F.concat(F.lit("Pfam="), F.array_join("domains", ","), F.lit(", "))).otherwise("")
    return g.select("name", F.concat(F.lit("cluster "), "name", F.lit(" size="), "size", F.lit(" taxa="), "taxa", F.lit(" "), pfam, F.lit("file: "), F.coalesce("file", F.lit("void")), F.lit(" dnafile: "), F.coalesce("dnafile", F.lit("void")), F.lit("\n"), "members").alias("value"))


def fasta_lines(seqs: DataFrame, width: int = 0) -> DataFrame:
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("seq")
    return seqs.withColumn("value", F.concat(F.lit(">"), "header", F.lit("\n"), body))


def cluster_files(members: DataFrame) -> DataFrame:
    """members(name, seq_id, header, protein, dna): lines of each cluster's .faa, and of its .fna if all members have DNA."""
    whole = members.groupBy("name").agg(F.bool_and(F.coalesce(F.col("dna") != "", F.lit(False))).alias("whole")).filter("whole").select("name")
    faa = members.select(F.concat("name", F.lit(".faa")).alias("file"), "seq_id", "header", F.col("protein").alias("seq"))
    fna = members.join(whole, "name", "left_semi").select(F.concat("name", F.lit(".fna")).alias("file"), "seq_id", "header", F.col("dna").alias("seq"))
    return fasta_lines(faa.unionByName(fna)).select("file", "seq_id", "value")


def write_cluster_fasta(members: DataFrame, path: str) -> None:
    """One folder per cluster with its FASTA: members(name, header, seq). Rows meet by cluster before the write."""
    fasta_lines(members).repartition("name").sortWithinPartitions("name", "header").select("name", "value").write.mode("overwrite").partitionBy("name").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """An ordered text; sorted by range, so parts concatenate in order."""
    lines.orderBy("ord").select("value").write.mode("overwrite").text(path)


def growth_lines(growth: DataFrame, value: str) -> DataFrame:
    """growth(sample, g, value): `g1 g2 ...`, then one line a sample."""
    head = growth.agg(F.max("g").alias("m")).select(F.lit(-1).alias("ord"), F.array_join(F.transform(F.sequence(F.lit(1), (F.col("m") + 1).cast("int")), lambda i: F.concat(F.lit("g"), i.cast("string"))), "\t").alias("value"))
    return head.unionByName(growth.groupBy("sample").agg(_ordered("g", F.col(value).cast("string"), "\t").alias("value")).select(F.col("sample").cast("int").alias("ord"), "value"))


def square_lines(cells: DataFrame, value: str, decimals: int = 2) -> DataFrame:
    """A square matrix of (t1, t2, value): two decimals, NA for null."""
    cell = F.when(F.col(value).isNull(), "NA").otherwise(F.format_string(f"%.{decimals}f", F.col(value)))
    head = cells.select("t2").distinct().agg(F.concat(F.lit("genomes\t"), _ordered("t2", F.col("t2").cast("string"), "\t")).alias("value")).select(F.lit(0).alias("ord"), "value")
    return head.unionByName(cells.groupBy("t1").agg(_ordered("t2", cell, "\t").alias("v")).select(F.row_number().over(W.orderBy("t1")).alias("ord"), F.concat_ws("\t", "t1", "v").alias("value")))


def _xml(c: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def orthoxml(clusters: DataFrame, origin: str = "panweave") -> DataFrame:
    """Lines of one XML text, ord and value: species with their genes, then ortholog groups with theirs, a gene a line.

    clusters(cluster_id, seq_id, taxon, name). ord is (section, taxon, cluster, step, seq), so write_lines() sorts the text
    by ranges and its parts, of any number, make it in their order; no row holds more than one gene.
    """
    def line(section: int, step: int, value: Column, taxon: str | None = None, cluster: str | None = None, seq: str | None = None) -> list[Column]:
        at = F.struct(F.lit(section).alias("section"), (F.col(taxon) if taxon else F.lit("")).alias("taxon"), (F.col(cluster) if cluster else F.lit(0)).cast("long").alias("cluster"), F.lit(step).alias("step"), (F.col(seq) if seq else F.lit(0)).cast("long").alias("seq"))
        return [at.alias("ord"), value.alias("value")]

    genes = clusters.select("seq_id", "taxon", "name").distinct()
    taxa, groups = genes.select("taxon").distinct(), clusters.select("cluster_id").distinct()
    one = clusters.sparkSession.range(1)
    id_ = F.col("seq_id").cast("string")
    parts = [
        one.select(*line(0, 0, F.lit(f'<?xml version="1.0" encoding="utf-8"?><orthoXML xmlns="http://orthoXML.org/2011/" version="0.3" origin="{origin}" originVersion="1">'))),
        taxa.select(*line(1, 0, F.concat(F.lit('<species name="'), _xml(F.col("taxon")), F.lit('"><database name="'), _xml(F.col("taxon")), F.lit('"><genes>')), "taxon")),
        genes.select(*line(1, 1, F.concat(F.lit('<gene id="'), id_, F.lit('" protId="'), _xml(F.col("name")), F.lit('"/>')), "taxon", seq="seq_id")),
        taxa.select(*line(1, 2, F.lit("</genes></database></species>"), "taxon")),
        one.select(*line(2, 0, F.lit("<groups>"))),
        groups.select(*line(3, 0, F.concat(F.lit('<orthologGroup id="'), F.col("cluster_id").cast("string"), F.lit('">')), cluster="cluster_id")),
        clusters.select(*line(3, 1, F.concat(F.lit('<geneRef id="'), id_, F.lit('"/>')), cluster="cluster_id", seq="seq_id")),
        groups.select(*line(3, 2, F.lit("</orthologGroup>"), cluster="cluster_id")),
        one.select(*line(4, 0, F.lit("</groups></orthoXML>"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seqxml(members: DataFrame, tag: str = "AAseq") -> DataFrame:
    """Lines of a SeqXML text a taxon, (taxon, ord, value): members(seq_id, taxon, name, seq) as an entry a line, by ids.

    ord is (step, seq_id); a taxon's lines in its order are its text.
    """
    entry = F.concat(F.lit('<entry id="'), _xml(F.col("name")), F.lit('" source="'), _xml(F.col("taxon")), F.lit(f'"><{tag}>'), "seq", F.lit(f"</{tag}></entry>"))
    head = '<seqXML seqXMLversion="0.4" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:noNamespaceSchemaLocation="http://www.seqxml.org/0.4/seqxml.xsd">'
    taxa = members.select("taxon").distinct()
    at = lambda step, seq: F.struct(F.lit(step).alias("step"), seq.cast("long").alias("seq")).alias("ord")
    ends = [taxa.select("taxon", at(k, F.lit(0)), F.lit(v).alias("value")) for k, v in ((0, head), (2, "</seqXML>"))]
    return members.select("taxon", at(1, F.col("seq_id")), entry.alias("value")).unionByName(ends[0]).unionByName(ends[1])


def genbank_lines(features: DataFrame, contigs: DataFrame) -> DataFrame:
    """GenBank flat records: contigs(contig, organism, dna), features(contig, ord, type, place, quals) -> (contig, value).

    place is a location such as `complement(join(1..9,20..30))`, quals an array of (name, value). A contig without
    features is a record with an empty table. One record is one row, as large as its contig.
    """
    indent = "\n" + " " * 21
    qual = lambda q: F.concat(F.lit(indent + "/"), q["name"], F.lit('="'), q["value"], F.lit('"'))
    feature = F.concat(F.lit("\n     "), F.rpad("type", 16, " "), "place", F.array_join(F.transform("quals", qual), ""))
    table = features.groupBy("contig").agg(_ordered("ord", feature, "").alias("table"))
    chunks = F.regexp_extract_all(F.lower("dna"), F.lit("(?s).{1,60}"), F.lit(0))
    origin = F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("\n"), F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.regexp_replace(c, "(.{10})(?=.)", "$1 "))), "")
    head = F.concat(F.lit("LOCUS       "), "contig", F.lit(" "), F.length("dna").cast("string"), F.lit(" bp    DNA\nVERSION     "), "contig", F.lit("\n  ORGANISM  "), "organism")
    return contigs.join(table, "contig", "left").select("contig", F.concat(head, F.lit("\nFEATURES             Location/Qualifiers"), F.coalesce("table", F.lit("")), F.lit("\nORIGIN"), origin, F.lit("\n//")).alias("value"))


def write_reports(lines: DataFrame, path: str) -> str:
    """lines(file, ord, value): one text file per `file` in a folder of its own; returns the pattern that reads them."""
    lines.repartition("file").sortWithinPartitions("file", "ord").select("file", "value").write.mode("overwrite").partitionBy("file").text(path)
    return f"{path}/*"


def write_records(lines: DataFrame, path: str) -> str:
    """lines(value): records in no order, written where they lie, a compressed text a task; returns the folder."""
    lines.select("value").write.mode("overwrite").text(path, compression="gzip")
    return path


def enriched_fasta(members: DataFrame, enriched: DataFrame) -> DataFrame:
    """members(cluster, seq_id, header, seq, domains) that carry an enriched domain, with cluster and domains in the header."""
    hit = members.select("*", F.explode(F.array_distinct("domains")).alias("domain")).join(enriched.select("domain").distinct(), "domain", "left_semi")
    rows = hit.groupBy("cluster", "seq_id", "header", "seq").agg(F.array_join(F.sort_array(F.collect_set("domain")), ",").alias("d"))
    return fasta_lines(rows.select("cluster", F.concat_ws(" ", "header", F.concat(F.lit("cluster="), F.col("cluster").cast("string")), F.concat(F.lit("domains="), "d")).alias("header"), "seq"))

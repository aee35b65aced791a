"""GenBank flat files: features with spliced sequence and qualifiers; a record is a piece, parsed where it is read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.functions import sequences as S
from panweave.sources.text import base_name, blocks

SCHEMA = ("file string, contig string, organism string, size int, ord int, type string, start int, end int, strand int, "
          "parts array<struct<a:int,b:int,strand:int>>, quals map<string,string>, dna string")
ARROW = pa.schema([("file", pa.string()), ("contig", pa.string()), ("organism", pa.string()), ("size", pa.int32()), ("ord", pa.int32()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("strand", pa.int32()),
                   ("parts", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("strand", pa.int32())]))), ("quals", pa.map_(pa.string(), pa.string())), ("dna", pa.string())])
#: Features, and letters of their sequences, that go back to Spark at a time.
ROWS, LETTERS = 8192, 1 << 24
_COMPLEMENT = str.maketrans("acgtACGT", "tgcaTGCA")


def _location(text: str) -> list[tuple[int, int, int]]:
    """(start, end, strand) of the parts in the order in which they are spliced.

    complement() turns what it holds, be it one part or a join: the parts come in reverse order, each on the other
    strand. Parts of other records, marks of open ends and unknown functions don't matter to the places.
    """
    text = re.sub(r"[A-Za-z_0-9.]+:", "", text)
    head, inner = text.partition("(")[0], text[text.find("(") + 1 : text.rfind(")")]
    if "(" not in text:
        m = re.match(r"[<>]?(\d+)(?:[.^]+[<>]?(\d+))?", text)
        return [(int(m[1]), int(m[2] or m[1]), 1)] if m else []
    parts, depth, at = [], 0, 0
    for i, c in enumerate(inner + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts += _location(inner[at:i])
            at = i + 1
    return [(a, b, -s) for a, b, s in reversed(parts)] if head.strip() == "complement" else parts


def _spliced(dna: str, parts: list[tuple[int, int, int]]) -> str:
    return "".join(dna[a - 1 : b] if s > 0 else dna[a - 1 : b][::-1].translate(_COMPLEMENT) for a, b, s in parts)


def parse(text: str) -> Iterator[dict]:
    """Features of every record of a text, in order; qualifiers join continued lines, translations without blanks."""
    for record in re.split(r"(?m)^//\s*$", text):
        locus = re.search(r"(?m)^LOCUS\s+(\S+)\s+(\d+) bp", record)
        if not locus:
            continue
        version = re.search(r"(?m)^VERSION\s+(\S+)", record)
        organism = re.search(r"(?m)^  ORGANISM\s+(.+)$", record)
        origin = record.partition("\nORIGIN")[2]
        dna = re.sub(r"[^A-Za-z]", "", origin.partition("\n")[2])
        table = record.partition("\nFEATURES")[2].partition("\nORIGIN")[0]
        for k, block in enumerate(re.split(r"\n(?=     \S)", table)[1:]):
            lines = block.split("\n")
            kind, _, place = lines[0].strip().partition(" ")
            quals: dict[str, str] = {}
            name = None
            for line in lines[1:]:
                line = line.strip()
                if line.startswith("/"):
                    name, _, value = line[1:].partition("=")
                    if name in quals:
                        quals[name] += ";" + value.strip('"')
                    else:
                        quals[name] = value.strip('"')
                elif name is None:
                    place += line
                else:
                    quals[name] += ("" if name == "translation" else " ") + line.strip('"')
            parts = _location(place.replace(" ", ""))
            if parts:
                yield {
                    "contig": version[1] if version else locus[1], "organism": organism[1].strip() if organism else None, "size": int(locus[2]), "ord": k, "type": kind,
                    "start": min(a for a, _, _ in parts), "end": max(b for _, b, _ in parts), "strand": -1 if all(s < 0 for *_, s in parts) else 1,
                    "parts": [{"a": a, "b": b, "strand": s} for a, b, s in parts], "quals": quals, "dna": _spliced(dna, parts),
                }


def features(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a feature; dna is spliced in the order and on the strand of the location, strand -1 if all of it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for feature in parse(text):
                    rows.append({"file": name, **feature, "quals": list(feature["quals"].items())})
                    size += len(feature["dna"])
                    if len(rows) >= ROWS or size >= LETTERS:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    return blocks(spark, path, "\n//").select(base_name(F.col("file")).alias("file"), "value").mapInArrow(run, SCHEMA)


def contains_cds(spark: SparkSession, path: str) -> DataFrame:
    """(file, cds): whether a file has any coding sequence."""
    return features(spark, path).groupBy("file").agg(F.bool_or(F.col("type") == "CDS").alias("cds"))


def coding(spark: SparkSession, path: str | list[str], kinds: tuple[str, ...] = ("CDS",)) -> DataFrame:
    """(file, id, header, protein, dna, left_id, right_id, ...): coding sequences with names, places and neighbours.

    Pseudogenes are skipped; ids come from protein_id, else locus_tag; a header occurs once; neighbours on the contig.
    """
    f = features(spark, path).filter(F.col("type").isin(*kinds))
    q = lambda k: F.try_element_at("quals", F.lit(k))
    pseudo = F.map_contains_key("quals", "pseudo") | F.coalesce(q("product").startswith("PSEUDO:") | q("note").startswith("PSEUDO:"), F.lit(False))
    f = f.filter(~pseudo).withColumn("id", F.coalesce(q("protein_id"), q("locus_tag"))).filter("id IS NOT NULL")
    protein = F.coalesce(q("translation"), F.regexp_replace(S.translate(F.col("dna")), r"\*$", ""))
    place = F.concat("contig", F.lit("("), "size", F.lit("):"), "start", F.lit("-"), "end", F.lit(":"), F.when(F.col("strand") == -1, "^").otherwise(""), F.lit("1"))
    header = F.concat(F.lit("ID:"), "id", F.lit(" |["), F.coalesce("organism", F.lit("")), F.lit("]|"), F.lit("|"), F.coalesce(q("gene"), F.lit("")), F.lit("|"), F.length("dna").cast("string"), F.lit("|"), F.coalesce(q("product"), F.lit("")), F.lit("|"), place)
    f = f.select("file", "contig", "ord", "start", "end", "strand", "id", header.alias("header"), protein.alias("protein"), "dna").withColumn("_n", F.row_number().over(W.partitionBy("file", "header").orderBy("contig", "ord"))).filter("_n = 1").drop("_n")
    w = W.partitionBy("file", "contig").orderBy("start", "ord")
    return f.withColumns({"left_id": F.lag("id").over(w), "left_strand": F.lag("strand").over(w), "right_id": F.lead("id").over(w), "right_strand": F.lead("strand").over(w)})


def genes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Gene features, translated; those with internal stops go."""
    f = features(spark, path).filter("type = 'gene'").withColumn("protein", F.regexp_replace(S.translate(F.col("dna")), r"\*$", ""))
    return f.filter(~S.has_internal_stop(F.col("protein")))

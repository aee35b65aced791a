"""Alignments: variant columns, blunt ends, fragment collapse, block trimming. msa(aln, name, seq) of equal lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def letters(msa: DataFrame) -> DataFrame:
    return msa.select("aln", "name", F.posexplode(F.split("seq", "")).alias("pos", "ch")).filter("ch <> ''").withColumn("pos", (F.col("pos") + 1).cast("long"))


def variants(msa: DataFrame) -> DataFrame:
    """(aln, pos, letters, snp, informative): columns with at least two letters.

    snp: two letters or more and no gap. informative: two characters or more that are each seen twice, a gap being one.
    """
    counts = letters(msa).withColumn("ch", F.upper("ch")).groupBy("aln", "pos", "ch").agg(F.count(F.lit(1)).alias("n"))
    col = counts.groupBy("aln", "pos").agg(
        F.sum(F.when(F.col("ch") != "-", 1).otherwise(0)).cast("long").alias("letters"), F.max(F.when(F.col("ch") == "-", 1).otherwise(0)).alias("gap"), F.sum(F.when(F.col("n") >= 2, 1).otherwise(0)).alias("twice"))
    return col.filter("letters >= 2").select("aln", "pos", "letters", (F.col("gap") == 0).alias("snp"), (F.col("twice") >= 2).alias("informative"))


def variant_counts(msa: DataFrame) -> DataFrame:
    v = variants(msa)
    return v.groupBy("aln").agg(F.sum(F.col("snp").cast("long")).alias("snps"), F.sum(F.col("informative").cast("long")).alias("informative"))


def private_variants(msa: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """(aln, pos, in_a, in_b): columns where all of a share one letter, all of b another, and neither has a gap."""
    ch = letters(msa).withColumn("ch", F.upper("ch"))
    pick = lambda names: F.collect_set(F.when(F.col("name").isin(names), F.col("ch")))
    g = ch.groupBy("aln", "pos").agg(pick(a).alias("sa"), pick(b).alias("sb")).filter("size(sa) = 1 AND size(sb) = 1")
    out = g.select("aln", "pos", F.get("sa", F.lit(0)).alias("in_a"), F.get("sb", F.lit(0)).alias("in_b"))
    return out.filter("in_a <> in_b AND in_a <> '-' AND in_b <> '-'")


def blunt(msa: DataFrame) -> DataFrame:
    """Cut to the columns from the last first residue to the first last residue."""
    edge = msa.withColumns({"lead": F.length(F.regexp_extract("seq", "^(-*)", 1)), "tail": F.length(F.regexp_extract("seq", "(-*)$", 1))})
    cut = edge.groupBy("aln").agg(F.max("lead").alias("lead"), F.max("tail").alias("tail"))
    return msa.join(cut, "aln").select("aln", "name", F.substr("seq", F.col("lead") + 1, F.greatest(F.length("seq") - F.col("lead") - F.col("tail"), F.lit(0))).alias("seq"))


def _reach(seq: Column, low: Column, high: Column) -> Column:
    """(low, high) moved inwards past the gaps that a sequence has there: places from 0, both inclusive."""
    lead = F.length(F.regexp_extract(F.substr(seq, low + 1), "^(-*)", 1))
    tail = F.length(F.regexp_extract(F.substr(seq, F.lit(1), high + 1), "(-*)$", 1))
    return F.struct((low + lead).cast("int").alias("low"), (high - tail).cast("int").alias("high"))


def diploid_block(msa: DataFrame, roles: DataFrame, min_weight: float = 3, min_length: int = 100, max_gaps: int = 100, min_cover: float = 0.5, isoform: str | None = None) -> DataFrame:
    """Alignments cut to the block of their diploids: (aln, taxon, role, name, seq).

    msa(aln, taxon, name, seq) of equal lengths; roles(taxon, role, weight, ord): diploid, outgroup or polyploid. The
    sequence with most bases (the first by name on ties) stands for a diploid or an outgroup. The block runs from the first
    place to the last that the diploids reach, taken in order of ord, each moving a border past the gaps that it has there.
    An alignment goes as a whole if its diploids' weights don't add up to more than min_weight, the block is shorter than
    min_length, a diploid has more than max_gaps gaps in it, or an outgroup that is there covers less than min_cover of it.
    Of a polyploid every sequence that covers min_cover stays, by falling number of bases, unless one of its taxon that
    stays already has the same columns where it reaches; with isoform, a pattern in names, only the first of each match.
    """
    bases = F.length(F.regexp_replace("seq", "[^ACGTN]", ""))
    roles = F.broadcast(roles) if roles.count() <= 10_000 else roles  # a row a taxon; a join by taxon would have few tasks
    own = msa.join(roles, "taxon").withColumn("bases", bases)
    order = W.partitionBy("aln", "taxon").orderBy(F.desc("bases"), "name")
    lead = own.filter("role <> 'polyploid'").withColumn("n", F.row_number().over(order)).filter("n = 1")
    diploid = lead.filter("role = 'diploid'").groupBy("aln").agg(F.sort_array(F.collect_list(F.struct("ord", "taxon", "seq"))).alias("d"), F.sum("weight").alias("weight"), F.max(F.length("seq")).alias("width"))
    start = F.struct(F.lit(0).alias("low"), (F.col("width") - 1).cast("int").alias("high"))
    block = diploid.filter(F.col("weight") > min_weight).select("aln", F.aggregate("d", start, lambda s, x: _reach(x["seq"], s["low"], s["high"])).alias("b"), "d").select("aln", "b.low", "b.high", "d")
    block = block.withColumn("size", F.col("high") - F.col("low") + 1).filter(F.col("size") >= min_length)
    cut = lambda seq: F.substr(seq, F.col("low") + 1, F.col("size"))
    gaps = lambda seq: F.length(cut(seq)) - F.length(F.replace(cut(seq), F.lit("-"), F.lit("")))
    block = block.filter(~F.exists("d", lambda x: gaps(x["seq"]) > max_gaps)).drop("d")

    placed = own.join(block, "aln").withColumn("r", _reach(F.col("seq"), F.col("low"), F.col("high"))).withColumn("covers", (F.col("r.high") - F.col("r.low") + 1) / F.col("size") >= min_cover)
    heads = placed.join(lead.select("aln", "taxon", "name"), ["aln", "taxon", "name"], "left_semi").filter("role <> 'polyploid'")
    poor = heads.filter("role = 'outgroup' AND NOT covers").select("aln").distinct()
    many = placed.filter("role = 'polyploid'")
    if isoform is not None:
        found = F.regexp_extract("name", isoform, 0)
        key = F.when(found == "", F.concat(F.lit("="), "name")).otherwise(found)
        many = many.withColumn("n", F.row_number().over(W.partitionBy("aln", "taxon", key).orderBy(F.desc("bases"), "name"))).filter("n = 1")
    # the sequences of one taxon in one alignment, in order; each is held against those that stay before it
    listed = many.filter("covers").groupBy("aln", "taxon", "role", "low", "size").agg(F.sort_array(F.collect_list(F.struct((-F.col("bases")).alias("k"), "name", "seq", F.col("r.low").alias("a"), F.col("r.high").alias("b")))).alias("s"))
    same = lambda x, y: F.substr(x["seq"], y["a"] + 1, y["b"] - y["a"] + 1) == F.substr(y["seq"], y["a"] + 1, y["b"] - y["a"] + 1)
    none = F.array().cast(listed.schema["s"].dataType)
    stay = F.aggregate("s", none, lambda kept, y: F.when(F.exists(kept, lambda x: same(x, y)), kept).otherwise(F.concat(kept, F.array(y))))
    kept = listed.select("aln", "taxon", "role", "low", "size", F.explode(stay).alias("x")).select("aln", "taxon", "role", "x.name", cut(F.col("x.seq")).alias("seq"))
    return heads.select("aln", "taxon", "role", "name", cut(F.col("seq")).alias("seq")).unionByName(kept).join(poor, "aln", "left_anti")


def collapse_fragments(msa: DataFrame, min_overlap: int = 40, max_mismatches: int = 0, max_gaps: int = 2) -> DataFrame:
    """Fragments of one taxon in an alignment that overlap without mismatches become one sequence.

    A greedy fold from left to right within (aln, taxon), which holds the fragments of one taxon in one alignment.
    """
    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name, seq in part.assign(lead=part.seq.map(lambda s: len(s) - len(s.lstrip("-")))).sort_values(["lead", "name"])[["name", "seq"]].itertuples(index=False):
            for row in rows:
                both = [(x, y) for x, y in zip(row[1], seq, strict=True) if x != "-" or y != "-"]
                lap = [(x, y) for x, y in zip(row[1], seq, strict=True) if x != "-" and y != "-"]
                inner = [i for i, (x, y) in enumerate(zip(row[1], seq, strict=True)) if x != "-" and y != "-"]
                gaps = sum((x == "-") != (y == "-") for x, y in zip(row[1][inner[0] : inner[-1] + 1], seq[inner[0] : inner[-1] + 1], strict=True)) if inner else 0
                if both and len(lap) >= min_overlap and sum(x != y for x, y in lap) <= max_mismatches and gaps <= max_gaps:
                    row[1] = "".join(x if x != "-" else y for x, y in zip(row[1], seq, strict=True))
                    row[0] += f"_{name}"
                    break
            else:
                rows.append([name, seq])
        return pd.DataFrame({"aln": part.aln.iloc[0], "taxon": part.taxon.iloc[0], "name": [r[0] for r in rows], "seq": [r[1] for r in rows]})

    kind = msa.schema["aln"].dataType.simpleString()
    return msa.groupBy("aln", "taxon").applyInPandas(run, f"aln {kind}, taxon string, name string, seq string")

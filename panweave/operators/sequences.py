"""Operators on sequence records (seq_id, taxon, header, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.functions import sequences as S
from panweave.operators.ranks import ranked
from panweave.tables import Tables


def number(records: DataFrame, order: list[str]) -> DataFrame:
    """seq_id 1..N in input order: by ord and file, then by `order` inside a file, which may be of any size."""
    return ranked(Tables(records.sparkSession, "numbers"), records, [], ["ord", "file", *order], "seq_id")


def taxon_ranges(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy("taxon").agg(F.min("seq_id").alias("first"), F.max("seq_id").alias("last"), F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).cast("long").alias("residues"))


def taxon_of_id(ids: DataFrame, ranges: DataFrame) -> DataFrame:
    """Taxon of each seq_id by range; ranges has one row per taxon and is broadcast by its size."""
    return ids.join(ranges.select("taxon", "first", "last"), F.col("seq_id").between(F.col("first"), F.col("last"))).select(*ids.columns, "taxon")


def dedup_identical(seqs: DataFrame) -> DataFrame:
    """(seq_id, rep_id, copies): identical sequences by hash of the upper-case text, the smallest id first."""
    h = F.sha2(F.upper("seq"), 256)
    first = seqs.groupBy(h.alias("h")).agg(F.min("seq_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"))
    return seqs.select("seq_id", h.alias("h")).join(first, "h").select("seq_id", "rep_id", "copies")


#: (gram, window, shortest, longest text in bytes): which minimisers find the containers of texts of which length.
SCHEMES = ((12, 12, 23, 255), (24, 232, 255, 1 << 62))


def _minimisers(gram: int, window: int):
    """Rows (node, seq) -> (node, mark): the distinct minimisers of all windows of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(gram)], np.uint64)
        for batch in batches:
            owner, marks = [], []
            for i, text in enumerate(batch.column(1)):
                data = np.frombuffer(text.as_py().encode(), np.uint8).astype(np.uint64)
                if len(data) < gram + window - 1:
                    continue
                h = sum((data[k : len(data) - gram + 1 + k] * power[k] for k in range(gram)), np.zeros(len(data) - gram + 1, np.uint64))
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                low, reach = h, 1
                while reach < window:  # the least of 1, 2, 4, ... successive grams, then of exactly `window`
                    step = min(reach, window - reach)
                    low = np.minimum(low[:-step], low[step:])
                    reach += step
                kept = np.unique(low)
                owner.append(np.full(len(kept), i))
                marks.append(kept)
            if owner:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(marks).view(np.int64))], names=["node", "mark"])
    return run


#: Bits of the filter that tells which grams of a text are worth a row: 1 MB in 256 rows of bits, whatever the input.
FILTER_BITS = 1 << 23


def _gram_hashes(data: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of every gram of that length) for lengths 1 to `longest` bytes; each follows from the one before."""
    h = np.zeros(len(data) + 1, np.uint64)
    for length in range(1, min(longest, len(data)) + 1):
        h = h[: len(data) - length + 1] * np.uint64(0x9E3779B97F4A7C15) + data[length - 1 :] + np.uint64(1)
        yield length, ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(41)


def _whole_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seq) -> (bit): the place in the filter of each text as one gram."""
    for batch in batches:
        bits = []
        for text in batch.column(0):
            data = np.frombuffer(text.as_py().encode(), np.uint8).astype(np.uint64)
            bits.append(int([h for _, h in _gram_hashes(data, len(data))][-1][0]))
        yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], names=["bit"])


def _grams_of(lengths: list[int], wanted: bytes, piece: int = 1 << 20):
    """Rows (rep, seq) -> (rep, gram): the distinct grams shorter than the text that the filter lets through, a piece at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, longest = np.frombuffer(wanted, np.uint8), max(lengths)
        for batch in batches:
            for rep, text in zip(batch.column(0), batch.column(1)):
                whole = np.frombuffer(text.as_py().encode(), np.uint8)
                for begin in range(0, len(whole), piece):
                    part = whole[begin : begin + piece + longest - 1]
                    grams = []
                    for length, h in _gram_hashes(part.astype(np.uint64), min(longest, len(whole) - 1)):
                        if length in lengths:
                            at = np.flatnonzero((filled[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1)
                            rows = np.lib.stride_tricks.sliding_window_view(part, length)[at]
                            grams += [g.tobytes() for g in np.unique(np.ascontiguousarray(rows).view(f"V{length}").ravel())]
                    if grams:
                        yield pa.RecordBatch.from_arrays([pa.array([rep.as_py()] * len(grams), pa.int64()), pa.array(grams, pa.binary())], names=["rep", "gram"])
    return run


def _containers_of_short(short: DataFrame, texts: DataFrame) -> DataFrame:
    """short(node, seq), distinct, not empty, below some 23 bytes -> (node, container): an equi-join on grams of their own lengths.

    A filter of fixed size over the short texts leaves out grams that none of them is; the join decides on the bytes. No
    text leaves its task but for such grams, and minima are taken before the shuffle.
    """
    bits = short.select("seq").mapInArrow(_whole_hash, "bit long").distinct()
    rows = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    lengths = sorted(r[0] for r in short.select(F.octet_length("seq")).distinct().collect())  # at most 22
    if not lengths:
        return short.select("node", F.col("node").alias("container"))
    filled = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for r in rows:  # bit k of the filter is in bucket k // 32768 + 1 (0 for k = 0), at (k - 1) % 32768
        place = np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")).astype(np.int64)
        k = (r["bucket"] - 1) * 32768 + place + 1 if r["bucket"] > 0 else np.zeros(1, np.int64)
        np.bitwise_or.at(filled, k >> 3, (1 << (k & 7)).astype(np.uint8))
    grams = texts.filter(F.octet_length("seq") > lengths[0]).select("rep", "seq").mapInArrow(_grams_of(lengths, filled.tobytes()), "rep long, gram binary")
    keys = short.select("node", F.encode("seq", "UTF-8").alias("gram"))
    return grams.join(keys, "gram").groupBy("node").agg(F.min("rep").alias("container"))


def contained(seqs: DataFrame, schemes: tuple[tuple[int, int, int, int], ...] = SCHEMES) -> DataFrame:
    """(seq_id, container): sequences that are a proper substring of another, with the smallest id of those that contain them.

    Copies are one class with its smallest id. Of every `window` successive grams the one with the smallest hash is kept
    (its minimiser). A text shares all minimisers of its windows with every text that contains it, so the rarest of them
    alone finds all containers by an equi-join, however common the others are; hits are confirmed on the texts. Long
    texts are found by minimisers of wide windows, of which there are few; short ones by those of narrow windows, of
    which only the short texts' own are moved. Texts too short for a window meet the grams of their own length. Null texts are in nothing and contain nothing; an empty one is in every other.
    """
    tables = Tables(seqs.sparkSession, "contained")
    own = seqs.filter("seq IS NOT NULL").select(F.col("seq_id").cast("long").alias("seq_id"), "seq", F.xxhash64("seq").alias("h1"), F.xxhash64(F.lit(7), "seq").alias("h2"))
    classes = tables.save(own.groupBy("h1", "h2").agg(F.min("seq_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()))
    heads = own.join(classes.select("h1", "h2", F.col("rep").alias("seq_id"), "node"), ["h1", "h2", "seq_id"]).dropDuplicates(["node"])
    texts = tables.save(heads.select("node", F.col("seq_id").alias("rep"), "seq"))
    size = F.octet_length("seq")
    pairs = []
    for gram, window, least, most in schemes:
        wanted = texts.filter(size.between(least, most)).select("node", "seq")
        asks = tables.save(wanted.mapInArrow(_minimisers(gram, window), "node long, mark long"))
        known = tables.save(asks.select("mark").distinct())
        answers = texts.filter(size > least).select("node", "seq").mapInArrow(_minimisers(gram, window), "node long, mark long").join(known, "mark", "left_semi")
        answers = tables.save(answers.select("node", "mark"))
        often = answers.groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
        rarest = asks.join(often, "mark").groupBy("node").agg(F.min(F.struct("n", "mark")).alias("m")).select("node", F.col("m.mark").alias("mark"))
        pairs.append(rarest.join(answers.withColumnRenamed("node", "other"), "mark").filter("node <> other").select("node", "other"))
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)
    found = tables.save(found)
    inside = (F.length("t") > F.length("s")) & F.contains(F.col("t"), F.col("s"))
    both = found.join(texts.select("node", F.col("seq").alias("s")), "node").join(texts.select(F.col("node").alias("other"), F.col("rep").alias("container"), F.col("seq").alias("t")), "other")
    held = both.filter(inside).select("node", "container")
    short = tables.save(texts.filter((size > 0) & (size < min(x[2] for x in schemes))).select("node", "seq"))
    empty = texts.filter(size > 0).agg(F.min("rep").alias("container")).filter("container IS NOT NULL")  # one row
    tried = _containers_of_short(short, texts).unionByName(texts.filter(size == 0).select("node").crossJoin(F.broadcast(empty)))
    first = tables.save(held.unionByName(tried).groupBy("node").agg(F.min("container").alias("container")))
    return own.join(classes.join(first, "node").select("h1", "h2", "container"), ["h1", "h2"]).select("seq_id", "container")


def longest_per_group(rows: DataFrame, group: str, used: str | None = None) -> DataFrame:
    """One isoform a gene: one in use first, then the longest, then the smallest id."""
    order = [*([F.desc(used)] if used else []), F.desc("length"), F.asc("seq_id")]
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter("_n = 1").drop("_n")


def by_length(seqs: DataFrame, least: int = 20, most: int = 25_000) -> DataFrame:
    """Sequences of allowed length with their place from 1 on, the longest first; ties by the hash of the id.

    Counts of cells (length, leading digits of the hash) give offsets, a row number inside a cell the rest, so a length
    that very many sequences have is split.
    """
    kept = seqs.filter(F.length("seq").between(least, most)).withColumns({"_length": F.length("seq"), "_mark": F.md5(F.col("seq_id").cast("string"))})
    cells = kept.withColumn("_cell", F.substring("_mark", 1, 2))
    sizes = cells.groupBy("_length", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    inside = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("_length").orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    per = sizes.groupBy("_length").agg(F.sum("_n").alias("_all"))  # one row a length, `most` at most
    longer = per.select("_length", (F.sum("_all").over(W.orderBy(F.desc("_length")).rowsBetween(W.unboundedPreceding, 0)) - F.col("_all")).alias("_longer"))
    begin = inside.join(longer, "_length").select("_length", "_cell", (F.col("_before") + F.col("_longer")).alias("_begin"))
    ranked = cells.withColumn("_i", F.row_number().over(W.partitionBy("_length", "_cell").orderBy("_mark", "seq_id"))).join(begin, ["_length", "_cell"])
    return ranked.select(*seqs.columns, (F.col("_begin") + F.col("_i")).cast("long").alias("place"))


def neighbours(genes: DataFrame) -> DataFrame:
    """genes(seq_id, contig, start, strand) with the ids and strands of the genes before and after on the contig."""
    w = W.partitionBy("contig").orderBy("start", "seq_id", "strand")
    return genes.select("*", F.lag("seq_id").over(w).alias("left_id"), F.lag("strand").over(w).alias("left_strand"), F.lead("seq_id").over(w).alias("right_id"), F.lead("strand").over(w).alias("right_strand"))


def intergenic(genes: DataFrame, contigs: DataFrame, least: int = 200, most: int = 700, flank: int = 180) -> DataFrame:
    """Segments between consecutive features: no overlap, size within limits, both flanking features long enough.

    genes(seq_id, contig, start, end, strand), contigs(contig, dna) -> flank, lower-case gap, flank as one text.
    """
    w = W.partitionBy("contig").orderBy("start", "seq_id")
    g = genes.withColumns({"r_id": F.lead("seq_id").over(w), "r_start": F.lead("start").over(w), "r_end": F.lead("end").over(w), "r_strand": F.lead("strand").over(w)})
    gap = F.col("r_start") - F.col("end") - 1
    ok = gap.between(least, most) & (F.col("end") - F.col("start") + 1 >= flank) & (F.col("r_end") - F.col("r_start") + 1 >= flank)
    text = F.concat(F.upper(F.substr("dna", F.col("end") - flank + 1, F.lit(flank))), F.lower(F.substr("dna", F.col("end") + 1, gap)), F.upper(F.substr("dna", F.col("r_start"), F.lit(flank))))
    return g.filter(ok).join(contigs, "contig").select("contig", F.col("seq_id").alias("left_id"), "r_id", F.col("strand").alias("left_strand"), "r_strand", gap.alias("size"), text.alias("seq"))


def twins_agree(nt: DataFrame, aa: DataFrame, *by: str) -> DataFrame:
    """One row (of every pair of files, named by the columns `by`): whether each translated nucleotide sequence matches the
    protein at the same place (place, seq).

    Sequences with N are skipped; either side may hold the other, without its last stop. A place that one side alone has,
    or an empty protein of a sequence that is not, does not match.
    """
    p = nt.select(*by, "place", F.col("seq").alias("dna")).join(aa.select(*by, "place", F.col("seq").alias("protein")), [*by, "place"], "full")
    made = F.regexp_replace(S.translate(F.col("dna")), r"\*$", "")
    given = F.regexp_replace("protein", r"\*$", "")
    held = (F.contains(made, given) & (given != "")) | (F.contains(given, made) & (made != "")) | (made == given)
    same = (held | F.upper("dna").rlike("N")) & F.col("protein").isNotNull()
    return p.groupBy(*by).agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("agree"))


def remove_gap_columns(msa: DataFrame) -> DataFrame:
    """msa(aln, name, seq) without the columns in which every sequence has a gap."""
    ch = msa.select("aln", "name", F.posexplode(F.split("seq", "")).alias("pos", "ch")).filter("ch <> ''")
    full = ch.groupBy("aln", "pos").agg(F.max(F.when(F.col("ch") != "-", 1).otherwise(0)).alias("some")).filter("some = 1").select("aln", "pos")
    kept = ch.join(full, ["aln", "pos"], "left_semi")
    return kept.groupBy("aln", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("seq"))


def include(seqs: DataFrame, listed: DataFrame) -> DataFrame:
    """Only listed taxa, numbered anew in the list's order: listed(ord, taxon)."""
    pos = seqs.join(listed.select("taxon", "ord"), "taxon").select("taxon", "ord", F.col("seq_id").alias("pos"), *[c for c in seqs.columns if c not in ("taxon", "seq_id")])
    return number(pos.withColumnRenamed("taxon", "file"), ["pos"]).withColumnRenamed("file", "taxon").select(*seqs.columns)


def representatives(records: DataFrame) -> DataFrame:
    """Pre-clustered files: the first record of each stands for it; all keep its id as rep_id."""
    return records.withColumn("rep_id", F.min("seq_id").over(W.partitionBy("file")))


def without_redundant(hsps: DataFrame, redundant: DataFrame) -> DataFrame:
    """Segments neither end of which is redundant."""
    for side in ("q", "s"):
        hsps = hsps.join(redundant.select(F.col("seq_id").alias(side)).distinct(), side, "left_anti")
    return hsps.select("q", "s", *[c for c in hsps.columns if c not in ("q", "s")])

"""Scalar functions on sequences and names, as Column expressions (nothing runs in Python)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code in TCAG order.
BASES = "TCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(("".join(c) for c in product(BASES, repeat=3)), AMINO, strict=True))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "acgtACGT", "tgcaTGCA"))


def translate(seq: Column, frame: int = 0) -> Column:
    """Protein of a frame (0-2); unknown codons give X, an incomplete last codon is left out."""
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    dna = F.substr(F.translate(seq, "acgtuU", "ACGTTT"), F.lit(frame + 1))
    codons = F.regexp_extract_all(dna, F.lit("(?s)..."), F.lit(0))  # cut once, so each codon is read once
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def six_frames(seq: Column) -> Column:
    """array<struct<frame, protein>>: frames 1-3 of the strand and -1 to -3 of its reverse complement."""
    back = reverse_complement(seq)
    return F.array(*[F.struct(F.lit(f + 1 if s is seq else -f - 1).alias("frame"), translate(s, f).alias("protein")) for s in (seq, back) for f in range(3)])


def longest_orf(seq: Column) -> Column:
    """The longest stretch without a stop over all six frames; the first on ties: struct(frame, protein)."""
    cut = F.flatten(F.transform(six_frames(seq), lambda x: F.transform(F.split(x["protein"], r"\*"), lambda p: F.struct(F.length(p).alias("n"), (-F.abs(x["frame"])).alias("f"), x["frame"].alias("frame"), p.alias("protein")))))
    top = F.array_max(cut)
    return F.struct(top["frame"].alias("frame"), top["protein"].alias("protein"))


def has_internal_stop(protein: Column) -> Column:
    return protein.rlike(r"\*[A-Za-z]")


def is_nucleotide(seq: Column) -> Column:
    return seq.rlike(r"(?i)^[ACGTUXN\-\s]+$")


def clean(seq: Column) -> Column:
    """Residues of a record: white space, gaps and dots go, case stays."""
    return F.regexp_replace(seq, r"[\s.-]", "")


def chop(seq: Column, n: int = 3) -> Column:
    return F.substr(seq, F.lit(n + 1), F.greatest(F.length(seq) - 2 * n, F.lit(0)))


def taxon_of(header: Column, single_words: bool = False) -> Column:
    """The last [bracketed] label; unless single words are allowed it needs a capital and two words."""
    last = F.element_at(F.regexp_extract_all(header, F.lit(r"\[([^\[\]]+)\]"), F.lit(1)), -1)
    found = F.when(F.size(F.regexp_extract_all(header, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))) > 0, last)
    return found if single_words else F.when(found.rlike(r"^[A-Z]\S*\s+\S+"), found)


def gene_name(header: Column) -> Column:
    """Fifth |-separated field."""
    return F.get(F.split(header, r"\|"), F.lit(4))


def coordinates(header: Column) -> Column:
    """acc(size):start-end:strand -> struct(contig, size, start, end, strand)."""
    pattern = r"([^\s|()]+)\((\d+)\):(\d+)-(\d+):(-?1|\^?[01-])"
    part = lambda i: F.regexp_extract(header, pattern, i)
    return F.struct(part(1).alias("contig"), part(2).cast("int").alias("size"), part(3).cast("int").alias("start"), part(4).cast("int").alias("end"), part(5).cast("int").alias("strand"))


def cluster_name(name: Column) -> Column:
    """A name fit for a file: anything but letters, digits, _ . - becomes _, runs of it one."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_"), "_+", "_")


def min_bits(residues: Column, sequences: Column) -> Column:
    """Effective least bit score of a search: half the log2 of residues^2 over a hundredth of the sequences."""
    return 0.5 * F.log2(residues * residues / (sequences * 0.01))

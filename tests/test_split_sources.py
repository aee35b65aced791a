"""One report read in many tasks gives the rows of one task."""

import random
from collections import Counter

import pytest

from panweave.sources import genbank, text


def reports(rng):
    dna = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    hmm = "# hmmscan :: search\n#\n" + "".join(
        f"Query:       {q}  [L={100 + q}]\n" + ("   [No hits detected that satisfy reporting thresholds]\n" if q % 3 == 0 else "".join(
            f">> PF{q:05d}.{k}  family {k} of {q}\n   #    score\n   {k} !   15.7   0.4   2.6e-06    0.0{k}78       1      16 [.     {q}     {q + k + 20} ..     283     300 .. 0.93\n" for k in range(1, 1 + q % 4))) + "//\n" for q in range(1, 60))
    lists = "# note\n" + "".join(f"cluster {c}_x size={c % 4 + 1} taxa={c % 3 + 1} {'Pfam=PF1,PF2, ' if c % 2 else ''}file: {c}.faa dnafile: void\n" + "".join(f": T{m}.gb\n" for m in range(c % 4 + 1)) for c in range(80))
    mcl = "(mclheader\nmcltype matrix\ndimensions 9x5\n)\n(mcldoms\n0 1 2 3 $\n)\n(mclmatrix\nbegin\n" + "".join(f"{c}    " + " ".join(str(100 * c + m) for m in range(3)) + "\n        " + " ".join(str(100 * c + m) for m in range(3, 3 + c % 5)) + " $\n" for c in range(60)) + ")\n"
    head = "source:/x\t" + "\t".join(f"c{k}{'+2' if k % 3 == 0 else ''}" for k in range(9))
    wide = head + "\t\n" + "".join(f"taxon{t}\t" + "\t".join("NA" if (t * k) % 11 == 5 else str((t * k) % 4) for k in range(9)) + "\t\n" for t in range(60)) + "reference\t" + "\t".join("1" * 9) + "\n"
    genes = head + "\n" + "".join(f"taxon{t}\t" + "\t".join("-" if (t + k) % 4 == 0 else f"g{t}_{k},h{k}," for k in range(9)) + "\n" for t in range(60))
    gb = "".join(
        f"LOCUS       X{c}     {60} bp    DNA\nVERSION     X{c}.1\n  ORGANISM  Some bug\nFEATURES             Location/Qualifiers\n     source          1..60\n     CDS             {1 + c % 5}..{30 + c % 5}\n                     /protein_id=\"P{c}\"\n                     /product=\"a // long\n                     name\"\n"
        f"     gene            complement(31..{45 + c % 3})\n                     /locus_tag=\"L{c}\"\nORIGIN\n        1 {dna(30)} {dna(30)}\n//\n" for c in range(40))
    exon = lambda a, b, tail: f"    +c:{a}-{b}  ({a}-{b})   100%{tail}\n"
    maps = "".join(f">t{t} of many\nPaths (1):\n  Path 1: query 1..20 (20 bp) => genome c:{100 + t}..{300 + t} (200 bp)\n  Alignment for path 1:\n" + exon(1, 5 + t % 4, " ->   ...120...  0.9") + exon(12, 15 + t % 5, "") for t in range(50))
    return {"hmm": hmm, "lists": lists, "mcl": mcl, "wide": wide, "genes": genes, "gb": gb, "maps": maps}


def read(spark, kind, path):
    if kind == "maps":
        return text.gmap(spark, path, spark.createDataFrame([(f"t{t}", "ACGTTGCAAC" * 2) for t in range(52)], "id string, seq string"))
    if kind == "lists":
        return text.cluster_list(spark, path).drop("place")
    return {"hmm": text.hmmer, "mcl": text.mcl_clusters, "wide": text.matrix, "genes": text.gene_matrix, "gb": genbank.coding}[kind](spark, path)


@pytest.mark.parametrize("kind", ["hmm", "lists", "mcl", "wide", "genes", "gb", "maps"])
@pytest.mark.parametrize("ends", ["\n", "\r\n"], ids=["unix", "windows"])
def test_splits_change_nothing(spark, tmp_path, kind, ends):
    content = reports(random.Random(1))[kind].replace("\n", ends)
    (tmp_path / kind).write_bytes(content.encode())
    path = f"file://{tmp_path}/{kind}"
    rows = lambda: Counter(str(r) for r in read(spark, kind, path).collect())
    one = rows()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(content) // 9))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert text.blocks(spark, path, "\n").rdd.getNumPartitions() > 8
        assert rows() == one
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    least = {"hmm": 79, "lists": 190, "mcl": 280, "wide": 500, "genes": 500, "gb": 40, "maps": 52}
    assert sum(one.values()) >= least[kind]


def test_pieces_keep_their_order(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"cluster {k} a=1\n: T{k}\n" for k in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [r["name"] for r in text.cluster_list(spark, f"file://{tmp_path}/x.txt").orderBy("place").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [str(k) for k in range(300)]

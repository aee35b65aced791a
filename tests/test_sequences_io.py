"""Sequence functions, alignments, sources and sinks."""

from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from panweave.functions import sequences as S
from panweave.operators import msa, sequences, stats
from panweave.sources import genbank, sinks, text


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def values(df):
    return sorted(map(tuple, df.collect()))


def test_scalar(spark):
    lit = F.lit
    assert one(spark, S.reverse_complement(lit("AACGTTn"))) == "nAACGTT"
    assert one(spark, S.translate(lit("ATGTAANNNGC"))) == "M*X" and one(spark, S.translate(lit("AT"))) == ""
    assert one(spark, S.taxon_of(lit("synthase [acyl-carrier] I [Buchnera aphidicola str. Bp]"))) == "Buchnera aphidicola str. Bp"
    assert one(spark, S.taxon_of(lit("x [Cu-Zn]"))) is None and one(spark, S.taxon_of(lit("x [abc]"), True)) == "abc"
    assert one(spark, S.chop(lit("ABCDEFGHI"))) == "DEF"
    assert one(spark, S.longest_orf(lit("ATGAAATAAGGGG")))[0] is not None
    assert tuple(one(spark, S.coordinates(lit("|NC_1(4000):10-99:-1")))) == ("NC_1", 4000, 10, 99, -1)
    assert one(spark, S.cluster_name(lit("12 a/b  c"))) == "12_a_b_c"
    assert one(spark, S.is_nucleotide(lit("acgtn-"))) and not one(spark, S.is_nucleotide(lit("MKV")))


def test_sequence_operators(spark):
    s = spark.createDataFrame([(1, "a", "h", "ACGTTGCAACGTACGGTTACGTAACCGGTTAA"), (2, "a", "h", "xxACGTTGCAACGTACGGTTACGTAACCGGTTAAyy"), (3, "b", "h", "acgttgcaacgtacggttacgtaaccggttaa"), (4, "b", "h", "short")], "seq_id long, taxon string, header string, seq string")
    assert values(sequences.dedup_identical(s)) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]
    assert values(sequences.contained(s)) == [(1, 2)]
    assert values(sequences.taxon_ranges(s)) == [("a", 1, 2, 2, 68), ("b", 3, 4, 2, 37)]
    assert values(sequences.taxon_of_id(s.select("seq_id"), sequences.taxon_ranges(s)))[2] == (3, "b")
    nt = spark.createDataFrame([(1, "ATGAAATAA"), (2, "ATGNAA")], "place int, seq string")
    aa = spark.createDataFrame([(1, "MK"), (2, "MQ")], "place int, seq string")
    assert sequences.twins_agree(nt, aa).first()[0]
    assert not sequences.twins_agree(nt, aa.withColumn("seq", F.lit("W"))).first()[0]


def test_intergenic(spark):
    dna = "A" * 10 + "C" * 5 + "G" * 10
    genes = spark.createDataFrame([(1, "c", 1, 10, 1), (2, "c", 16, 25, -1)], "seq_id long, contig string, start int, end int, strand int")
    contigs = spark.createDataFrame([("c", dna)], "contig string, dna string")
    (r,) = sequences.intergenic(genes, contigs, 3, 9, 4).collect()
    assert r["seq"] == "AAAA" + "ccccc" + "GGGG" and r["size"] == 5


def test_alignment(spark):
    cols = ["AAAA", "AACC", "AAAC", "A-CC"]
    rows = [("x", str(i), "".join(c[i] for c in cols)) for i in range(4)]
    m = spark.createDataFrame(rows, "aln string, name string, seq string")
    v = {r["pos"]: (r["snp"], r["informative"]) for r in msa.variants(m).collect()}
    assert v == {2: (True, True), 3: (True, False), 4: (False, False)}
    gaps = spark.createDataFrame([("x", "1", "--AC-"), ("x", "2", "-TA--")], "aln string, name string, seq string")
    assert values(msa.blunt(gaps)) == [("x", "1", "A"), ("x", "2", "A")]
    assert values(sequences.remove_gap_columns(gaps)) == [("x", "1", "-AC"), ("x", "2", "TA-")]
    p = spark.createDataFrame([("x", "1", "AG"), ("x", "2", "AG"), ("x", "3", "AT")], "aln string, name string, seq string")
    assert values(msa.private_variants(p, ["1", "2"], ["3"])) == [("x", 2, "G", "T")]
    f = spark.createDataFrame([("x", "t", "1", "ACGT----"), ("x", "t", "2", "--GTAA--"), ("x", "t", "3", "----CC--")], "aln string, taxon string, name string, seq string")
    assert values(msa.collapse_fragments(f, min_overlap=2).select("name", "seq")) == [("1_2", "ACGTAA--"), ("3", "----CC--")]


def write(path, content):
    path.write_text(content)
    return f"file://{path}"


def test_fasta(spark, tmp_path):
    p = write(tmp_path / "a.fa", ">one a->b [Homo sapiens]\nAC-GT\nac.gt\n\n>two\n# note\nMKV\n>empty\n")
    rows = text.fasta(spark, p).orderBy("pos").collect()
    assert [(r["header"], r["seq"]) for r in rows] == [("one a->b [Homo sapiens]", "ACGTacgt"), ("two", "MKV")]
    assert text.fasta(spark, p, skip_peptides=True).count() == 1  # V marks a peptide
    assert values(text.taxa_of(text.fasta(spark, p))) == [("Homo sapiens", 1)]


def test_tables(spark, tmp_path):
    p = write(tmp_path / "h.tsv", "1\t1058\t59.496\t516\t521\t522\t1\t515\t10\t515\t9.22e-210\t 730\n")
    (r,) = text.hsps(spark, p).collect()
    assert (r["q"], r["s"], r["evalue"], r["bits"]) == (1, 1058, 9.22e-210, 730.0)
    p = write(tmp_path / "p.tsv", "1\tPF1,PF2,\ta;b;\n2\t\t\n")
    assert values(text.domains(spark, p)) == [(1, ["PF1", "PF2"], ["a", "b"]), (2, [], [])]
    p = write(tmp_path / "ids.csv", "1,t.gb,x, y hash1\n")
    assert values(text.ids(spark, p)) == [(1, "t.gb", "x, y #1")]
    p = write(tmp_path / "names.txt", "# c\nb\n\na extra\n")
    assert values(text.names(spark, p)) == [(1, "b"), (2, "a")]
    p = write(tmp_path / "g.tab", "g1\tg2\n5\t3\n6\t2\n")
    assert values(text.growth_table(spark, p)) == [(0, 0, 5), (0, 1, 3), (1, 0, 6), (1, 1, 2)]


def test_matrix_round_trip(spark, tmp_path):
    p = write(tmp_path / "m.tab", "source:/x\tc1\tc2+3\tsep\t\nA\t1\t0\tNA\t\nB\t2\t1\tNA\t\nreference\t1\t1\t1\n")
    pan = text.matrix(spark, p)
    assert values(text.drop_separators(pan)) == [("A", "c1", 1), ("A", "c2", 0), ("B", "c1", 2), ("B", "c2", 1)]
    lines = [r["value"] for r in sinks.matrix_lines(text.drop_separators(pan), "/x").orderBy("ord").collect()]
    assert lines == ["source:/x\tc1\tc2", "A\t1\t0", "B\t2\t1"]
    assert [r["value"] for r in sinks.phylip_lines(text.drop_separators(pan)).orderBy("ord").collect()] == ["         2      2", "0000000000    10", "0000000001    11"]
    assert sinks.presence_csv(text.drop_separators(pan)).count() == 3
    assert sinks.wide(text.drop_separators(pan), ["c1", "c2"]).orderBy("taxon").collect()[1][1:] == (2, 1)
    sinks.write_lines(sinks.matrix_lines(text.drop_separators(pan), "/x", True), f"file://{tmp_path}/out")
    g = write(tmp_path / "g.tab", "source:/x\tc1\tc2\nA\ti1,i2,\t-\n")
    assert values(text.gene_matrix(spark, g)) == [("A", "c1", ["i1", "i2"]), ("A", "c2", [])]


def test_cluster_list(spark, tmp_path):
    p = write(tmp_path / "x.cluster_list", "# note\ncluster 601_repA size=2 taxa=2 file: 601.faa dnafile: void\n: A.gb\n: B.gb\ncluster 1_x size=1 taxa=1 Pfam=PF1,PF2, file: 1.fna aminofile: 1.faa\n: A.gb\n"
              "cluster O size=1 taxa=1 taxa(gdna)=NA cdnafile: O.cdna.fna cdsfile: O.cds.fna pepfile: O.cds.faa gdnafile: void\n: C\n")
    rows = [(r["name"], r["size"], r["domains"], r["file"], r["dnafile"], r["taxon"]) for r in text.cluster_list(spark, p).orderBy("place").collect()]
    assert rows == [("601_repA", 2, [], "601.faa", None, "A.gb"), ("601_repA", 2, [], "601.faa", None, "B.gb"), ("1_x", 1, ["PF1", "PF2"], "1.faa", "1.fna", "A.gb"), ("O", 1, [], "O.cds.faa", "O.cds.fna", "C")]
    out = sinks.cluster_list_lines(text.cluster_list(spark, p)).orderBy("name").collect()
    assert out[0]["value"] == "cluster 1_x size=1 taxa=1 Pfam=PF1,PF2, file: 1.faa dnafile: 1.fna\n: A.gb"
    m = write(tmp_path / "m.mcl", "(mclheader\n)\n(mclmatrix\nbegin\n0       1 2\n        3 $\n1       4 $\n)\n")
    assert values(text.mcl_clusters(spark, m)) == [(0, 1), (0, 2), (0, 3), (1, 4)]


def test_hmmer(spark, tmp_path):
    p = write(tmp_path / "r.hmm", "Query:       7  [L=300]\n>> PF10602.5  subunit RPN7\n   #    score\n   1 !   15.7   0.4   2.6e-06    0.0078       1      16 [.     283     298 ..     283     300 .. 0.93\n//\nQuery:       8  [L=3]\n   [No hits detected that satisfy reporting thresholds]\n")
    assert sorted(map(tuple, text.hmmer(spark, p).collect()), key=str) == [(7, "PF10602", "subunit RPN7", 0.0078, 283, 298), (8, None, None, None, None, None)]


def test_gmap(spark, tmp_path):
    p = write(tmp_path / "g.txt", ">t1\nPaths (1):\n  Path 1: query 1..9 (9 bp) => genome c:100..1 (9 bp)\n  Alignment for path 1:\n    -c:100-97  (1-3)   99% ->   ...101...  0.9\n    -c:50-44  (6-9)   100%\n")
    t = spark.createDataFrame([("t1", "AACCCGGGT"), ("t2", "ACGT")], "id string, seq string")
    assert values(text.gmap(spark, p, t).select("id", "hit", "seq", "median_intron"))[0] == ("t1", "-c:1:100", "ACCCGTT", 101.0)


GB = """LOCUS       X1     40 bp    DNA
VERSION     X1.1
  ORGANISM  Some bug
FEATURES             Location/Qualifiers
     source          1..40
     CDS             1..9
                     /protein_id="P1"
                     /gene="g"
                     /product="a long
                     name"
     CDS             complement(join(11..13,
                     20..25))
                     /locus_tag="L2"
     CDS             30..32
                     /pseudo
                     /locus_tag="L3"
     tRNA            33..35
                     /locus_tag="T"
ORIGIN
        1 atgaaataac ccgggtttaa accctttggg aaacccattt
//
"""


def test_genbank(spark, tmp_path):
    p = write(tmp_path / "x.gb", GB)
    rows = {r["id"]: r for r in genbank.coding(spark, p).collect()}
    assert set(rows) == {"P1", "L2"} and rows["P1"]["protein"] == "MK" and rows["P1"]["right_id"] == "L2"
    assert rows["L2"]["dna"] == "AGGGTTGGG".lower() or len(rows["L2"]["dna"]) == 9
    assert "a long name" in rows["P1"]["header"] and "X1.1(40):1-9:1" in rows["P1"]["header"]
    assert values(genbank.contains_cds(spark, p)) == [("x.gb", True)]
    assert genbank.features(spark, p).filter("type = 'tRNA'").count() == 1


def test_input_order_and_sinks(spark, tmp_path):
    stored = spark.createDataFrame([("b", 1), ("a", 2)], "file string, ord int")
    found = spark.createDataFrame([("a",), ("b",), ("d",), ("c",)], "file string")
    assert sorted((r["ord"], r["file"]) for r in text.input_order(found, stored).collect()) == [(1, "b"), (2, "a"), (3, "c"), (4, "d")]
    members = spark.createDataFrame([("c1", "h1", "ACGT"), ("c1", "h2", "AC"), ("c2", "h3", "A")], "name string, header string, seq string")
    sinks.write_cluster_fasta(members, f"file://{tmp_path}/fa")
    assert (tmp_path / "fa" / "name=c1").is_dir()
    c = spark.createDataFrame([(1, 1, "A & B", "x<y")], "cluster_id long, seq_id long, taxon string, name string")
    sinks.write_lines(sinks.orthoxml(c.unionByName(c.selectExpr("2L AS cluster_id", "2L AS seq_id", "'B' AS taxon", "'z' AS name"))), f"file://{tmp_path}/xml")
    whole = ElementTree.fromstring("".join(f.read_text() for f in sorted((tmp_path / "xml").glob("part-*"))))
    name = "{http://orthoXML.org/2011/}"
    assert [s.get("name") for s in whole.iter(f"{name}species")] == ["A & B", "B"] and [g.get("protId") for g in whole.iter(f"{name}gene")] == ["x<y", "z"]
    assert [[r.get("id") for r in g] for g in whole.iter(f"{name}orthologGroup")] == [["1"], ["2"]]
    rows = sinks.seqxml(spark.createDataFrame([(2, "A", "b", "MK"), (1, "A", "a", "WW")], "seq_id long, taxon string, name string, seq string")).orderBy("taxon", "ord").collect()
    assert [e.get("id") for e in ElementTree.fromstring("".join(r["value"] for r in rows))] == ["a", "b"]


def test_statistics(spark):
    counts = spark.createDataFrame([("PF1", 9, 10), ("PF2", 1, 90)], "domain string, exp long, ctrl long")
    best = stats.enrichment(counts, cutoff=1.0).collect()
    assert best[0]["domain"] == "PF1" and best[0]["p"] < 0.05 and best[0]["q"] == pytest.approx(2 * best[0]["p"])
    rates = spark.createDataFrame([("f", 99.0, 5), ("f", 1.0, 5), ("f", float("nan"), 5), ("g", 1.0, 3)], "file string, omega double, n_of_seqs int")
    assert values(stats.rate_summary(rates)) == [("f", 0.5, 2)]
    occ = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (2, 4.0)], "occ int, omega double")
    t = stats.trend(occ).first()
    assert t["f"] == pytest.approx(8.0) and t["slope"] == pytest.approx(2.0)


def test_small_operators(spark):
    from panweave.operators import clusters, matrix

    s = spark.createDataFrame([(1, "a", "h", "ACGT"), (2, "b", "h", "AC"), (3, "b", "h", "A"), (4, "c", "h", "T")], "seq_id long, taxon string, header string, seq string")
    listed = spark.createDataFrame([(1, "b"), (2, "a")], "ord int, taxon string")
    assert values(sequences.include(s, listed).select("seq_id", "taxon", "seq")) == [(1, "b", "AC"), (2, "b", "A"), (3, "a", "ACGT")]
    assert values(sequences.representatives(s.withColumnRenamed("taxon", "file")).select("seq_id", "rep_id")) == [(1, 1), (2, 2), (3, 2), (4, 4)]
    h = spark.createDataFrame([(1, 2, 9.0), (2, 3, 9.0), (1, 4, 9.0)], "q long, s long, bits double")
    assert values(sequences.without_redundant(h, spark.createDataFrame([(3,)], "seq_id long"))) == [(1, 2, 9.0), (1, 4, 9.0)]
    n = spark.createDataFrame([("10_b",), ("9_a",), ("x",)], "name string")
    assert [r["name"] for r in clusters.by_leading_number(n).collect()] == ["x", "9_a", "10_b"]
    assert values(matrix.totals(s, spark.createDataFrame([(3,)], "seq_id long"))) == [("a", 1, 4), ("b", 1, 2), ("c", 1, 1)]
    t = spark.createDataFrame([("PF1", "x", 2), ("PF1", "y", 3), ("PF2", "y", 1)], "domain string, tool string, n long")
    assert values(stats.merge_tools(t, ["x", "y"])) == [("PF1", 2, 3), ("PF2", 0, 1)]
    m = spark.createDataFrame([("c1", 1, "h1", "MK", ["PF1", "PF2"]), ("c2", 2, "h2", "MV", [])], "cluster string, seq_id long, header string, seq string, domains array<string>")
    assert [r["value"] for r in sinks.enriched_fasta(m, t.filter("tool = 'x'")).collect()] == [">h1 cluster=c1 domains=PF1\nMK"]

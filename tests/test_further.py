"""Operators of the second round: locations, files, graphs, growth and the whole analyses, against plain versions."""

import bz2
import gzip
import itertools
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from panweave.config import Config
from panweave.operators import graph, growth, homology, matrix, search, sequences
from panweave.plans import pipelines
from panweave.sources import genbank, sinks, text
from panweave.tables import Tables


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_locations():
    where = genbank._location
    assert where("<5..>9") == [(5, 9, 1)] and where("7") == [(7, 7, 1)]
    assert where("complement(5..9)") == [(5, 9, -1)]
    assert where("join(1..3,complement(5..9),12)") == [(1, 3, 1), (5, 9, -1), (12, 12, 1)]
    assert where("complement(join(1..3,5..9))") == [(5, 9, -1), (1, 3, -1)]
    assert where("join(complement(5..9),complement(1..3))") == [(5, 9, -1), (1, 3, -1)]
    assert where("order(X1.2:1..3,J00194.1:5..9)") == [(1, 3, 1), (5, 9, 1)]
    assert genbank._spliced("AACCGGTTACGT", where("join(complement(9..12),complement(1..3))")) == "ACGTGTT"
    assert genbank._spliced("AACCGGTTACGT", where("complement(join(1..3,9..12))")) == "ACGTGTT"


def test_strands_of_a_file(spark, tmp_path):
    record = ("LOCUS       X1     40 bp    DNA\nFEATURES             Location/Qualifiers\n     CDS             join(complement(10..20),complement(1..5))\n                     /locus_tag=\"A\"\n"
              "     CDS             join(1..3,complement(5..9))\n                     /locus_tag=\"B\"\nORIGIN\n        1 aaccggttac gtaaccggtt aaccggttac gtaaccggtt\n//\n")
    (tmp_path / "x.gb").write_text(record)
    rows = {r["quals"]["locus_tag"]: r for r in genbank.features(spark, f"file://{tmp_path}/x.gb").collect()}
    assert rows["A"]["strand"] == -1 and rows["A"]["dna"] == "aaccggttacg" + "cggtt"
    assert rows["B"]["strand"] == 1 and rows["B"]["dna"] == "aac" + "taacc"
    assert [p["a"] for p in rows["A"]["parts"]] == [10, 1]


def test_records_come_back_from_a_flat_file(spark, tmp_path):
    contigs = spark.createDataFrame([("c1", "Some bug", "ACGTACGTAC" * 13), ("c2", "Other bug", "ACGT")], "contig string, organism string, dna string")
    features = spark.createDataFrame([("c1", 1, "CDS", "complement(2..10)", [("locus_tag", "L1")])], "contig string, ord int, type string, place string, quals array<struct<name:string,value:string>>")
    path = sinks.write_reports(sinks.genbank_lines(features, contigs).select(F.lit("f").alias("file"), F.col("contig").alias("ord"), "value"), f"file://{tmp_path}/gb")
    (r,) = genbank.features(spark, path).collect()
    assert (r["contig"], r["organism"], r["size"], r["dna"]) == ("c1", "Some bug", 130, "gtacgtacg")


def test_compressed_files_by_their_first_bytes(spark, tmp_path):
    body = b">a [T one]\nAC\nGT\n# note\n>b\n\n>c [T two]\nMKV\n"
    (tmp_path / "plain").write_bytes(body)
    (tmp_path / "zipped").write_bytes(gzip.compress(body))
    (tmp_path / "squeezed").write_bytes(bz2.compress(body))
    rows = text.packed_fasta(spark, f"file://{tmp_path}").collect()
    assert sorted((r["file"], r["header"], r["seq"]) for r in rows) == sorted((f, h, s) for f in ("plain", "zipped", "squeezed") for h, s in (("a [T one]", "ACGT"), ("c [T two]", "MKV")))


def test_one_file_of_many_taxa(spark):
    rec = spark.createDataFrame([(0, "x [B]", "MKV"), (1, "y [A]", "MLL"), (2, "z [B]", "ACGT"), (3, "w [B]", "MPP"), (4, "v", "MQQ")], "pos long, header string, seq string")
    assert values(text.by_taxon(rec)) == [("A", 1, 1, "y [A]", "MLL"), ("B", 2, 2, "x [B]", "MKV"), ("B", 2, 3, "w [B]", "MPP")]


def test_by_length(spark):
    rng = random.Random(1)
    rows = [(i, "A" * rng.choice((5, 20, 21, 21, 21, 40))) for i in range(300)]
    got = sequences.by_length(spark.createDataFrame(rows, "seq_id long, seq string")).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, len(got) + 1)) and {r["seq_id"] for r in got} == {i for i, s in rows if len(s) >= 20}
    sizes = [len(r["seq"]) for r in got]
    assert sizes == sorted(sizes, reverse=True)


def test_triangles_at_a_hub(spark):
    """A hub with very many links, and random links beside it, against all triples."""
    rng = random.Random(2)
    edges = {(0, i) for i in range(1, 120)} | {tuple(sorted(rng.sample(range(1, 120), 2))) for _ in range(300)}
    taxon = {i: f"T{i % 7}" for i in range(120)}
    links = spark.createDataFrame([(a, b, taxon[a], taxon[b]) for a, b in edges], "a long, b long, ta string, tb string")
    want = sorted((x, y, z) for x, y, z in itertools.combinations(range(120), 3) if {(x, y), (y, z), (x, z)} <= edges and len({taxon[x], taxon[y], taxon[z]}) == 3)
    assert sorted(map(tuple, graph.triangles(links).collect())) == want


def test_allotment_by_genomes_then_size(spark):
    taxon = {1: "A", 2: "B", 3: "C", 4: "A", 5: "A", 6: "B", 7: "C", 8: "D"}
    # 1 lies in a cluster of 3 genomes and in one of 2 genomes with more members; 6 in two alike
    clusters = spark.createDataFrame([(10, 1), (10, 2), (10, 3), (11, 1), (11, 4), (11, 5), (11, 2), (12, 6), (12, 7), (13, 6), (13, 8)], "cluster_id long, seq_id long")
    taxa = spark.createDataFrame(list(taxon.items()), "seq_id long, taxon string")
    assert values(graph.allot(clusters, taxa)) == [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (7, 7), (8, 8)]


def test_soft_core_is_what_counting_gives(spark):
    rng = random.Random(3)
    taxa = list("abcdefgh")
    rows = [(t, f"c{k}", 1) for k in range(60) for t in taxa if rng.random() < rng.choice((0.2, 0.9))]
    orders = growth.permutations(spark, taxa, 6, 4)
    order = defaultdict(dict)
    for r in orders.collect():
        order[r["sample"]][r["g"]] = r["taxon"]
    pan = spark.createDataFrame(rows, "taxon string, cluster string, n long")
    for share in (0.95, 0.6, 0.3):
        want = {}
        for s, o in order.items():
            for g in range(len(taxa)):
                seen = {o[i] for i in range(g + 1)}
                held = Counter(c for t, c, _ in rows if t in seen)
                want[s, g] = (sum(n == g + 1 for n in held.values()), len(held), sum(n >= int((g + 1) * share) for n in held.values()))
        got = {(r["sample"], r["g"]): (r["core"], r["pan"], r["soft"]) for r in growth.growth(pan, orders, share).collect()}
        assert got == want


def test_gower_distance(spark):
    rng = random.Random(4)
    rows = [(t, f"c{k}", rng.randrange(1, 5)) for k in range(30) for t in "abcd" if k % 5 == 0 or rng.random() < 0.6]
    n = {(t, c): v for t, c, v in rows}
    names = sorted({c for _, c, _ in rows})
    span = {c: max(n.get((t, c), 0) for t in "abcd") - min(n.get((t, c), 0) for t in "abcd") for c in names}
    got = {(r["t1"], r["t2"]): r["gower"] for r in matrix.distances(spark.createDataFrame(rows, "taxon string, cluster string, n long")).collect()}
    for a, b in itertools.combinations("abcd", 2):
        want = sum(abs(n.get((a, c), 0) - n.get((b, c), 0)) / span[c] for c in names if span[c]) / len(names)
        assert abs(got[a, b] - want) < 1e-5


def test_nonredundant_pangenome(spark):
    pan = spark.createDataFrame([("T", c, n) for c, n in (("a", 1), ("b", 2), ("c", 4), ("d", 8), ("e", 16))], "taxon string, cluster string, n long")
    lengths = spark.createDataFrame([("a", 50), ("b", 40), ("c", 30), ("d", 30), ("e", 20)], "cluster string, length int")
    # a absorbs b, b absorbs c, c and d are as long and c comes first; e only covers too little of d
    rows = [("b", "a", 99.0, 50.0, 95.0), ("c", "b", 99.0, 50.0, 95.0), ("d", "c", 99.0, 95.0, 95.0), ("c", "d", 99.0, 95.0, 95.0), ("e", "d", 99.0, 99.0, 50.0), ("a", "e", 10.0, 99.0, 99.0)]
    pairs = spark.createDataFrame(rows, "q string, s string, pident double, qcov double, scov double")
    counts, names, order = pipelines.nonredundant(Tables(spark, "nr"), pan, lengths, pairs, 95, 90)
    assert values(counts) == [("T", "a", 3), ("T", "e", 16)]
    assert values(names) == [("a", "a+3", ["b", "c", "d"]), ("e", "e", [])]
    assert [r["cluster"] for r in order.collect()] == ["a", "e"]
    assert values(pipelines.nonredundant(Tables(spark, "nr"), pan, lengths, pairs, 95, 90, short=True)[1]) == [("a", "a", []), ("b", "b", []), ("c", "c+2", ["d", "e"])]


def test_transcript_plan(spark):
    """An isoform goes before clustering, a gene of its own is a cloud gene, and growth leaves both out."""
    fam = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVVHSLAKWKRQ"
    rows = [(i, f"T{i}", fam[i:]) for i in range(4)] + [(10, "T0", fam[:60]), (11, "T1", "GSHMASMTGGQQMGRDLYDDDDKDPMLKRWWWCCNPPEHH")]
    seqs = spark.createDataFrame(rows, "seq_id long, taxon string, seq string")
    names = seqs.select("seq_id", "taxon")
    hsps = Tables(spark, "hsps").save(search.search(seqs).join(names.selectExpr("seq_id AS q", "taxon AS tq"), "q").join(names.selectExpr("seq_id AS s", "taxon AS ts"), "s"))
    cover = lambda a, b, n: (100.0 * (F.col(b) - F.col(a) + 1) / F.col(n))
    hits = Tables(spark, "hits").save(homology.ranked(hsps.select("q", "s", "tq", "ts", "evalue", "pident", cover("qs", "qe", "qlen").alias("qcov"), cover("ss", "se", "slen").alias("scov"), "bits")))
    out = pipelines.transcripts(spark, hits, seqs, hsps.withColumn("n_segments", F.lit(1)), samples=2)
    assert values(out.extra["redundant"]) == [(10, 0)] and values(out.extra["cloud"]) == [(11,)]
    assert {r["seq_id"] for r in out.clusters.collect()} == {0, 1, 2, 3}
    assert {r["core"] for r in out.extra["initial"].collect()} == {1}
    assert all(r["g"] == 0 for r in out.extra["increments"].collect())


def test_pairs_of_a_gene_with_itself(spark):
    p = spark.createDataFrame([(1, "a", "a"), (2, "b", "c"), (3, "c", "c")], "ord int, a string, b string")
    assert values(pipelines.pairs_to_clusters(Tables(spark, "p"), p)) == [("a", "a"), ("b", "b"), ("b", "c")]


def test_a_cluster_has_nucleotides_only_if_all_members_have(spark):
    m = spark.createDataFrame([("x", 1, "h1", "MK", "ACGT"), ("x", 2, "h2", "MK", None), ("y", 3, "h3", "MK", "AC")], "name string, seq_id long, header string, protein string, dna string")
    assert values(sinks.cluster_files(m)) == [("x.faa", 1, ">h1\nMK"), ("x.faa", 2, ">h2\nMK"), ("y.faa", 3, ">h3\nMK"), ("y.fna", 3, ">h3\nAC")]


def test_sparse_markov_clusters(spark):
    """Dense blobs with weak bridges: matrices in memory and joins over cells give the same clusters."""
    rng = random.Random(9)
    links = []
    for blob in range(6):
        own = range(100 * blob, 100 * blob + 12)
        links += [(a, b, 5.0 + rng.random()) for a, b in itertools.combinations(own, 2) if rng.random() < 0.8]
        links.append((100 * blob, 100 * ((blob + 1) % 6) + 5, 0.5))
    df = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in links] + [(9000, 9001, 1.0)], "a long, b long, w double")
    dense = values(graph.mcl(Tables(spark, "m"), df, dense=1000))
    assert len({c for _, c in dense}) == 7 and values(graph.mcl(Tables(spark, "m"), df, dense=10)) == dense


def test_row_texts_fill_the_gaps(spark):
    rows = [("a", "c2", 3), ("a", "c5", 1), ("b", "c1", 2), ("c", "c3", 4), ("c", "c1", 0)]
    pan = spark.createDataFrame(rows, "taxon string, cluster string, n long")
    assert values(matrix.positions(pan, "cluster")) == [("c1", 0), ("c2", 1), ("c3", 2), ("c5", 3)]
    assert values(matrix.binary_strings(pan)) == [("a", "0101"), ("b", "1000"), ("c", "0010")]
    assert [r["value"] for r in sinks.matrix_lines(pan, "x").orderBy("ord").collect()] == ["source:x\tc1\tc2\tc3\tc5", "a\t0\t3\t0\t1", "b\t2\t0\t0\t0", "c\t0\t0\t4\t0"]
    many = spark.range(5000, numPartitions=7).selectExpr("lpad(id * 7919 % 5000, 5, '0') AS k")
    assert [r["pos"] for r in matrix.positions(many, "k").orderBy("k").collect()] == list(range(5000))

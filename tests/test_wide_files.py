"""Files with a column a cluster: a cell carries its own column's name, not the header."""

from pyspark.sql import functions as F

from panweave.sources import text


def test_wide_gene_matrix(spark, tmp_path):
    n = 20_000
    lines = ["source:x\t" + "\t".join(f"cluster{i}+2" for i in range(n))]
    lines += [f"taxon{t}\t" + "\t".join(f"g{t}_{i}a,g{t}_{i}b," if (i + t) % 3 else "-" for i in range(n)) for t in range(12)]
    (tmp_path / "wide.tab").write_text("\n".join(lines) + "\n")
    found = text.gene_matrix(spark, f"file://{tmp_path}/wide.tab")
    right = F.col("genes") == F.when((F.substr("cluster", F.lit(8)).cast("int") + F.substr("taxon", F.lit(6)).cast("int")) % 3 == 0, F.array().cast("array<string>")).otherwise(
        F.array(*[F.concat(F.lit("g"), F.substr("taxon", F.lit(6)), F.lit("_"), F.substr("cluster", F.lit(8)), F.lit(e)) for e in "ab"]))
    assert tuple(found.agg(F.count(F.lit(1)), F.count_distinct("taxon", "cluster"), F.bool_and(right)).first()) == (12 * n, 12 * n, True)

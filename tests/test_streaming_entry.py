import re
import subprocess
import sys
from pathlib import Path

from panweave.streaming import incremental

ROOT = Path(__file__).resolve().parents[1]


def test_pending(spark):
    taxa = spark.createDataFrame([("A",), ("B",)], "taxon string")
    stored = spark.createDataFrame([("A", "A"), ("A", "B")], "ta string, tb string")
    assert sorted(map(tuple, incremental.pending_pairs(taxa, stored).collect())) == [("B", "A"), ("B", "B")]
    assert incremental.minimal_pairs(incremental.pending_pairs(taxa, stored), "A").count() == 2


def test_follow(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = "1\t2\t90\t10\t10\t10\t1\t10\t1\t10\t1e-9\t50\n"
    for k in range(3):
        (tmp_path / "in" / f"{k}.tsv").write_text(row)
        incremental.follow_hits(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == k + 1


def test_entry_works_without_the_corpus_operators(tmp_path):
    """The library and its queries import with the llm subpackage and the pipeline taken out."""
    code = "import re, sys; sys.modules['panweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and not [k for k in q if re.match(r'op\\d+_', k) or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "panweave").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "panweave").parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path

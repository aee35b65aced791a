"""GenBank files are written compressed, where the records lie."""

import glob

import pytest

from panweave.plans import files
from panweave.sources import genbank


@pytest.mark.parametrize("name", ["genbank_features", "intergenic_segments"])
def test_records_are_written_compressed_and_not_by_file(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(files, "_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    d = "/root/testdata/sf0.001"
    getattr(files, name)(spark, d)
    assert glob.glob(f"{tmp_path}/genbank/*.txt.gz") and not glob.glob(f"{tmp_path}/genbank/**/*.txt", recursive=True)
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    found = genbank.features(spark, f"file://{tmp_path}/genbank")
    assert found.count() == li.count() and found.select("contig").distinct().count() == li.select("l_orderkey").distinct().count()

"""Folded hits are written in compressed parts."""

import glob

from panweave.plans import files
from panweave.sources import text


def test_folded_parts_are_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    d = "/root/testdata/sf0.001"
    found = files.folded_hit_table(spark, d)
    assert glob.glob(f"{tmp_path}/bpo/*.csv.gz") and not glob.glob(f"{tmp_path}/bpo/*.csv")
    rows = files._hsps(spark, d)
    assert found.count() == 2 * rows.count() == 2 * text.bpo(spark, f"file://{tmp_path}/bpo").count()

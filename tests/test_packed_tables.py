"""Tables of hits are written in compressed parts."""

import glob

from panweave.plans import files
from panweave.sources import text


def test_hsp_parts_are_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    found = files.hsp_table(spark, "/root/testdata/sf0.001")
    assert glob.glob(f"{tmp_path}/hsps/*.csv.snappy") and not glob.glob(f"{tmp_path}/hsps/*.csv")
    rows = files._hsps(spark, "/root/testdata/sf0.001")
    assert found.count() == rows.count() and found.exceptAll(rows.select(*found.columns)).isEmpty()
    assert text.hsps(spark, f"file://{tmp_path}/hsps").count() == found.count()

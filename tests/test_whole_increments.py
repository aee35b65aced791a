"""pan_increments: genes and homologs come from all lines."""

import datetime

from panweave.plans import registry


def test_lines_of_any_quantity_count(spark, tmp_path, monkeypatch):
    from panweave.plans import filters_and_sinks as plans

    d, month = str(tmp_path), lambda m: datetime.date(2024, m, 3)
    spark.createDataFrame([(1, month(1), 20.0), (2, month(1), 20.0), (2, month(2), 20.0), (3, month(2), 20.0), (4, month(3), 20.0), (1, month(3), 20.0)], "l_partkey long, l_shipdate date, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    orders = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3)], "sample int, g int, taxon long")
    monkeypatch.setattr(plans.R, "_orders", lambda pan: orders)
    out = registry.QUERIES["pan_increments"](spark, d).collect()
    assert sorted(tuple(r) for r in out) == [(0, 0, 2), (0, 1, 1), (0, 2, 1)]

"""Lanes of very many spans: no table that grows with the spans goes through the driver, however small its files are."""

from panweave.operators import ranks
from panweave.tables import Tables


class Recorded(Tables):
    def __init__(self, *args):
        super().__init__(*args)
        self.plans = []

    def save(self, df):
        self.plans.append(plan(df))
        return super().save(df)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_are_not_broadcast(spark):
    rows = [(f"c{i % 3}", i, i + i % 7, i) for i in range(200)]
    tables = Recorded(spark, "put")
    out = ranks.lanes(tables, spark.createDataFrame(rows, "contig string, start long, end long, id long"), ["contig"], "start", "end", "id")
    joins = [p for p in [*tables.plans, plan(out)] if "Join" in p and "_begin" not in p]  # sizes of ranges are small
    assert len(joins) >= 4 and not any("Broadcast" in p for p in joins)
    assert out.count() == 200

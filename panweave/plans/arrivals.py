"""Queries over hits that arrive in several files."""

from __future__ import annotations

from pyspark.sql import functions as F

from panweave.plans import registry as R
from panweave.plans import views as V
from panweave.plans.registry import query
from panweave.streaming import incremental
from panweave.tables import Tables


@query(f"""WITH RECURSIVE {R._BEST_SQL}, l AS MATERIALIZED ({R._RECIPROCAL.format('best')}),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
  SELECT node, min(seen) AS component FROM r GROUP BY node""")
def incremental_clusters(spark, d):
    """All hits arrive in three parts, in no order of their scores; clusters are brought up to date after each."""
    tables = Tables(spark, "arrivals")
    hits = tables.save(V.hits(spark, d))
    source, target, checkpoint = (tables.folder(name) for name in ("in", "state", "progress"))
    for part in range(3):
        hits.filter((7 * F.col("q") + F.col("s")) % 3 == part).write.mode("append").parquet(source, compression="zstd")
        incremental.follow_clusters(spark, source, target, checkpoint, R.CFG).awaitTermination()
    return incremental.current_clusters(spark, target)

"""Incremental runs: new hit files join what is stored, pair by pair of taxa, and clusters are carried from arrival to arrival.

The batch form is an anti-join of taxon pairs against the stored partitions. The streaming forms read new files as they
arrive; a batch that is replayed after a failure computes the same rows from the batches before it and overwrites its own
folders, so nothing is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from panweave.config import HITS, HSPS, Config
from panweave.operators import graph, homology
from panweave.tables import Tables


def pending_pairs(taxa: DataFrame, stored: DataFrame) -> DataFrame:
    """(ta, tb) pairs of taxa, self pairs included, that no stored result has. Size: taxa squared, as the task has."""
    a, b = taxa.select(F.col("taxon").alias("ta")), taxa.select(F.col("taxon").alias("tb"))
    return a.crossJoin(b).join(stored.select("ta", "tb").distinct(), ["ta", "tb"], "left_anti")


def minimal_pairs(pairs: DataFrame, reference: str) -> DataFrame:
    """Only pairs with the reference taxon, and self pairs."""
    return pairs.filter((F.col("ta") == reference) | (F.col("tb") == reference) | (F.col("ta") == F.col("tb")))


def new_pairs(hits: DataFrame, stored: DataFrame) -> DataFrame:
    """Hits of taxon pairs that aren't stored yet."""
    return hits.join(stored.select(F.col("ta").alias("tq"), F.col("tb").alias("ts")).distinct(), ["tq", "ts"], "left_anti")


def follow_hits(spark: SparkSession, source: str, target: str, checkpoint: str, max_files: int = 100) -> StreamingQuery:
    """Appends the rows of new tab-separated hit files under `source` to Parquet under `target`, a folder a batch."""
    stream = spark.readStream.schema(HSPS).option("sep", "\t").option("maxFilesPerTrigger", max_files).option("ignoreLeadingWhiteSpace", True).csv(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- clusters of reciprocal best hits, carried along --------------------------------------------------------------------

TIES = "q long, s long, tq string, ts string, evalue double, pident double, qcov double, scov double"
MEMBERS = "node long, component long"


class ClusterState:
    """What the batches so far say, as two tables in the folder `target`, each a chain of folders whole=*/batch=*.

    ties: of each query and foreign taxon the hits that tied for the best E-value when they came; the best only falls, so
    those at the lowest are the present ones. members: the component of each node that a batch touched, null where it lost
    its last link; the newest row of a node counts. A whole=1 folder holds all that was known, and nothing before it is read.
    """

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target

    def create(self) -> None:
        for name, schema in (("ties", TIES), ("members", MEMBERS)):
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.target}/{name}/whole=1/batch=-1")

    def _rows(self, name: str, schema: str, before: int | None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, whole int, batch long").parquet(f"{self.target}/{name}")
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        newest = rows.filter("whole = 1").select("batch").distinct().agg(F.max("batch")).first()[0]
        return rows.filter(F.col("batch") >= (-1 if newest is None else newest))

    def ties(self, before: int | None = None) -> DataFrame:
        return self._rows("ties", TIES, before).drop("whole", "batch")

    def members(self, before: int | None = None) -> DataFrame:
        rows = self._rows("members", MEMBERS, before)
        return rows.groupBy("node").agg(F.max_by("component", "batch").alias("component")).filter("component IS NOT NULL")

    def put(self, name: str, rows: DataFrame, batch: int, whole: bool) -> DataFrame:
        """Writes a batch's rows and returns them as they were written."""
        path = f"{self.target}/{name}/whole={int(whole)}/batch={batch}"
        rows.write.mode("overwrite").parquet(path, compression="zstd")
        return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _links(ties: DataFrame, cfg: Config) -> DataFrame:
    """(a, b) of the best hits that pass the cutoffs both ways."""
    return homology.reciprocal(homology.best(ties, cfg), cfg).select("a", "b")


def update_clusters(state: ClusterState, batch: DataFrame, batch_id: int, cfg: Config, whole: bool = False) -> None:
    """Takes one batch of hits into the state.

    Only keys (q, ts) of the batch can change their best hits, so a link that comes has both ends among the new ties of those
    keys, and one that goes lies in the old component of such a q. The old components of these nodes are taken apart and put
    together again from the present ties of their members; no link leaves them, so all other components stay as they are and
    are not read as links.
    """
    spark = batch.sparkSession
    tables, state = Tables(spark, "arrival"), ClusterState(spark, state.target)
    usable = F.col("q").isNotNull() & F.col("s").isNotNull() & (F.col("evalue") >= 0) & ~F.isnan("evalue")
    columns = [c.split()[0] for c in TIES.split(", ")]
    # the batch meets the known ties of its keys in one move; what is worse than another row of its key leaves before it
    met = batch.select(*columns).filter(usable).withColumn("_new", F.lit(True)).unionByName(state.ties(batch_id).select(*columns).withColumn("_new", F.lit(False)))
    row = W.partitionBy("q", "ts", *[c for c in columns if c not in ("q", "ts")]).orderBy("_new")  # a row that is known comes first
    added = homology.top_ties(met).withColumn("_n", F.row_number().over(row)).filter("_n = 1 AND _new").select(*columns)
    if whole:
        added = tables.save(added)
        state.put("ties", homology.top_ties(state.ties(batch_id).unionByName(added)).dropDuplicates(), batch_id, whole)
    else:
        added = state.put("ties", added, batch_id, whole)
    # a tie that is no longer the best was a link only inside the component of its query, which is taken apart anyway
    touched = added.select(F.explode(F.array("q", "s")).alias("node")).distinct()
    members = state.members(batch_id)
    opened = members.join(touched, "node", "left_semi").select("component").distinct()
    nodes = tables.save(members.join(opened, "component", "left_semi").select("node").unionByName(touched).distinct())
    now = state.ties(batch_id).unionByName(added).join(nodes.withColumnRenamed("node", "q"), "q", "left_semi").select(*columns)
    found = graph.components(tables, _links(now, cfg))
    rows = nodes.join(found, "node", "left").select("node", "component")
    if whole:
        rows = members.join(nodes, "node", "left_anti").select("node", "component").unionByName(rows.filter("component IS NOT NULL"))
    state.put("members", rows, batch_id, whole)
    tables.clear()


def follow_clusters(spark: SparkSession, source: str, target: str, checkpoint: str, cfg: Config, max_files: int = 100, whole_every: int = 20) -> StreamingQuery:
    """Keeps clusters (components of reciprocal best hits) up to date as Parquet files of hits arrive under `source`.

    current_clusters(spark, target) reads them. After any number of arrivals, in any order, they equal those of one run over
    all hits. Hits without a query, a subject or an E-value of 0 or more are left out; repeated hits count once; an arrival
    without rows changes nothing. Every `whole_every` batches the state is written anew, so the chain stays short.
    """
    state = ClusterState(spark, target)
    state.create()

    def take(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            update_clusters(state, batch, batch_id, cfg, whole=batch_id % whole_every == whole_every - 1)

    stream = spark.readStream.schema(HITS).option("maxFilesPerTrigger", max_files).parquet(source)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_clusters(spark: SparkSession, target: str) -> DataFrame:
    """(node, component) of every node with a link, component the smallest node of it."""
    return ClusterState(spark, target).members()

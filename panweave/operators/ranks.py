"""Exact ranks and lanes without a task that holds a group: rows in ranges, counts of ranges, row numbers inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panweave.tables import Tables

MAX_ROUNDS = 60


def ranked(tables: Tables, rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """rows with their place from 1 on inside each group of `by` (all of them if it is empty), in `order`.

    Rows are dealt by ranges of group and order, so a large group lies in many partitions; a window sees the rows of one
    group in one partition, another the partitions of a group. Rows that the order leaves equal lie in one partition:
    callers end the order with what tells rows apart, such as an id.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not by:  # a range is one partition's rows in their order, so they are numbered as they are written
        laid = tables.save(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
        laid = laid.withColumns({"_part": F.shiftright("_at", 33), "_i": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1})
        sizes = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        begins = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_begin"))  # one row a range
        return laid.join(begins, "_part").select(*rows.columns, (F.col("_begin") + F.col("_i")).cast("long").alias(name))
    laid = tables.save(rows.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()))
    sizes = laid.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    begins = sizes.withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order))
    placed = laid.withColumn("_i", inside)
    same = [placed[c].eqNullSafe(begins[c]) for c in by] + [placed["_part"] == begins["_part"]]
    met = placed.join(begins, same).select(*[placed[c] for c in placed.columns if c != "_part"], begins["_begin"])
    return met.withColumn(name, (F.col("_begin") + F.col("_i")).cast("long")).drop("_begin", "_i")


def lanes(tables: Tables, spans: DataFrame, by: list[str], start: str, end: str, key: str) -> DataFrame:
    """spans with a lane from 0 on, so that spans of one group and lane don't touch: as few lanes as there are spans over
    one place. start, end: numbers, both inclusive, start <= end; key orders spans that are alike. Groups aren't null.

    A sweep by start opens a lane only where every one is taken, and else goes on in the lane that became free first: the
    k-th span that finds a free lane follows the span with the k-th end. So each span knows the one before it in its lane
    by its ranks, and jumping from those to theirs finds the lanes' first spans in a round a doubling.

    Ranks lie in few bytes of a file, so a table of very many spans looks small enough to broadcast, which takes all of it
    through the driver: tables that grow with the spans are joined by merging.
    """
    meet = lambda left, right, how="inner", on=("_s",): left.join(right.hint("merge"), [*by, *on], how)
    begun = tables.save(ranked(tables, spans, by, [start, end, key], "_s"))  # from here on a span is its rank
    ends = tables.save(ranked(tables, begun.select(*by, start, end, "_s"), by, [end, start, "_s"], "_e").select(*by, end, "_s", "_e"))
    # how many ends lie before a start: both in one order, ends at a place after starts at it
    marks = begun.select(*by, F.col(start).alias("_at"), F.lit(0).alias("_kind"), "_s").unionByName(ends.select(*by, F.col(end).alias("_at"), F.lit(1).alias("_kind"), F.col("_e").alias("_s")))
    place = ranked(tables, marks, by, ["_at", "_kind", "_s"], "_p").filter("_kind = 0")
    # open lanes at a start are the most spans at once so far; a span opens one if it makes them more
    depth = place.select(*by, "_s", (2 * F.col("_s") - F.col("_p")).alias("_depth"))
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = tables.save(depth.repartitionByRange(n, *by, "_s").withColumn("_part", F.spark_partition_id()))
    tops = laid.groupBy(*by, "_part").agg(F.max("_depth").alias("_top"))
    tops = tops.withColumn("_before", F.coalesce(F.max("_top").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(*by, "_part", "_before")
    run = W.partitionBy(*by, "_part").orderBy("_s").rowsBetween(W.unboundedPreceding, 0)
    most = F.greatest("_before", F.max("_depth").over(run))
    chain = tables.save(meet(laid, tops, on=["_part"]).select(*by, "_s", most.alias("_most")))
    heads = tables.save(chain.groupBy(*by, "_most").agg(F.min("_s").alias("_s")).select(*by, "_s", (F.col("_most") - 1).alias("lane")))  # the first span of every lane
    # all spans so far but the lanes' first ones have followed an end each
    after = meet(chain, heads.select(*by, "_s"), "left_anti").select(*by, "_s", (F.col("_s") - F.col("_most")).alias("_e"))
    up = meet(after, ends.select(*by, "_e", F.col("_s").alias("_up")), on=["_e"]).select(*by, "_s", "_up")
    up = tables.save(up.unionByName(heads.select(*by, "_s", F.col("_s").alias("_up"))))
    for _ in range(MAX_ROUNDS):
        above = up.select(*by, F.col("_s").alias("_up"), F.col("_up").alias("_next"))
        new = tables.save(meet(up, above, on=["_up"]).select(*by, "_s", F.col("_next").alias("_up"), (F.col("_next") != F.col("_up")).alias("_moved")))
        settled = new.filter("_moved").isEmpty()
        tables.drop(up)
        if settled:
            found = meet(new.select(*by, "_s", "_up"), heads.withColumnRenamed("_s", "_up"), on=["_up"]).select(*by, "_s", F.col("lane").cast("long").alias("lane"))
            return meet(begun, found).select(*spans.columns, "lane")
        up = new
    raise RuntimeError(f"a lane is longer than 2 ** {MAX_ROUNDS} spans")


def genome_map(tables: Tables, genes: DataFrame, clusters: DataFrame, compartments: DataFrame, reference: str) -> DataFrame:
    """Where clusters lie on a reference genome: (contig, cluster, seq_id, start, end, strand, compartment, lane).

    genes(seq_id, taxon, contig, start, end, strand), clusters(cluster, seq_id), compartments(cluster, compartment). Genes
    of the reference that are in a cluster are placed on their contigs, in lanes in which no two of them touch.
    """
    own = genes.filter(F.col("taxon") == reference).join(clusters.select("cluster", "seq_id").hint("merge"), "seq_id").join(compartments.select("cluster", "compartment"), "cluster", "left")
    own = tables.save(own.select("contig", "cluster", "seq_id", "start", "end", "strand", "compartment"))
    return lanes(tables, own, ["contig"], "start", "end", "seq_id").select("contig", "cluster", "seq_id", "start", "end", "strand", "compartment", "lane")

"""Hard-negative mining by norm-bucketed search.

Candidates are sorted by norm and laid on shelves: runs of bounded size in falling order of norm. A score is at most the
product of two norms (Cauchy-Schwarz), so an anchor visits a shelf, and inside it a bucket, only while its own norm times
the greatest norm there reaches what it still looks for: the lower limit of its window, or the k-th score that it has
already found, whichever is more. Norms fall along a shelf, so the first bucket that fails ends the visit.

1. Positives: shelves in order of label and norm. An anchor visits the first shelf of its label; its k-th score there
   is the floor with which it visits the label's other shelves, those that can still reach it.
2. Negatives: shelves in order of norm over all labels. Every positive opens a window of scores; windows of one anchor
   share a visit and each keeps a list and a floor of its own. First the shelf of the greatest norms, then those that
   can still reach the floor of one of the windows.

Lists of shelves are merged as a tree. The bound is raised by a billionth, so rounding never prunes; a bucket whose bound
equals the k-th score is still read, since a tie may go to a smaller id. Pruning changes what is read, never the result.

Defined cases: a vector that is null or holds a null or non-finite component, one whose scaled component no double can
hold, and rows with a null label or id take no part; vectors meet only vectors of their own length; rows that repeat an
id are rows of their own, and only the row itself is left out; an anchor without another row of its label has no
positive, a positive without a row in its window (always so for a negative positive score) has no row in the result;
ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panweave.llm import _vectors as V
from panweave.llm._spark import Tables, read, tidy

POSITIVES, NEGATIVES = 5, 3
FROM_PERCENT, TO_PERCENT = 50, 95
EVERY = 50
BUCKET = 2048

LISTS = "ask long, slot int, part int, seat long, id long, score long"
WINDOWS = "array<struct<slot:int,low:long,high:long,floor:long>>"


def visit(shelf: V.Rows, asks: V.Rows, windows: tuple[np.ndarray, ...], k: int, same: bool, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The first k rows of a shelf in every window: (window, place on the shelf, score, pairs multiplied).

    windows: owner (place among the asks), low, high and floor of each. same: candidates have the anchor's label, else
    another one.
    """
    owner, low, high, floor = windows
    floor = floor.copy()
    shelf_order = np.argsort(-shelf.norm, kind="stable")
    won, place, score, work = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for at in range(0, len(shelf_order), bucket):
        here = shelf_order[at : at + bucket]
        with np.errstate(over="ignore", invalid="ignore"):
            reach = asks.norm[owner] * shelf.norm[here[0]] * (1 + 1e-9)
        live = np.flatnonzero(~(reach < floor.astype(np.float64) * np.where(floor < 0, 1 + 1e-9, 1 - 1e-9)))
        if not len(live):
            break  # norms fall, floors only rise
        some, local = np.unique(owner[live], return_inverse=True)
        part, own = shelf.take(here), asks.take(some)
        scores = V.products(own, part)
        work += scores.size
        fit = (own.label[:, None] == part.label[None]) == same
        fit &= (own.dim[:, None] == part.dim[None]) & (own.seat[:, None] != part.seat[None])
        scores = np.where(fit, scores, V.LOW)[local]
        scores[(scores < np.maximum(low, floor)[live, None]) | (scores > high[live, None])] = V.LOW
        i, j = V.contenders(scores, k)
        won, place, score = np.concatenate((won, live[i])), np.concatenate((place, here[j])), np.concatenate((score, scores[i, j]))
        best = V.first(won, score, shelf.id[place], shelf.seat[place], k)
        won, place, score = won[best], place[best], score[best]
        full = np.flatnonzero(np.bincount(won, minlength=len(owner)) == k)
        if len(full):
            least = np.full(len(owner), V.HIGH)
            np.minimum.at(least, won, score)
            floor[full] = np.maximum(floor[full], least[full])
    return won, place, score, work


def _visits(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shelf, asks in V.meetings(batches):
            lists = asks.table["windows"].combine_chunks()
            fields = lists.flatten()
            slot, low, high, floor = (fields.field(c).to_numpy() for c in ("slot", "low", "high", "floor"))
            owner = np.repeat(np.arange(len(asks.id)), np.diff(lists.offsets.to_numpy()))
            won, place, score, _ = visit(shelf, asks, (owner, low, high, floor), k, same)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asks.seat[owner[won]], slot[won], np.full(len(won), shelf.shard, np.int32), shelf.seat[place], shelf.id[place], score)],
                                             names=["ask", "slot", "part", "seat", "id", "score"])
    return run


def shelved(tables: Tables, rows: DataFrame, shards: int, *order: Column | str) -> DataFrame:
    """Rows in ranges of the order, ties split by the row's number: adds shard."""
    return tables.save(rows.repartitionByRange(shards, *order, "seat").withColumn("shard", F.spark_partition_id()))


def _search(tables: Tables, asks: DataFrame, shelves: DataFrame, reach: DataFrame, k: int, same: bool, group_rows: int) -> DataFrame:
    """The lists of every window of the asks (ROWS, windows); reach: (seat of the ask, shard, top, head), the shelves that
    an ask may visit, the greatest norm there, and whether it goes there first."""
    n = asks.count()
    parts = (shelves.agg(F.max("shard")).first()[0] or 0) + 1

    def round_(where: Column, now: DataFrame, rows: int) -> DataFrame:
        groups = max(1, -(-n // rows))
        least = F.array_min(F.transform("windows", lambda w: F.greatest(w["low"], w["floor"]))).cast("double")
        pairs = now.join(reach.filter(where), "seat").filter(F.col("norm") * F.col("top") * (1 + 1e-9) >= least * F.when(least < 0, 1 + 1e-9).otherwise(1 - 1e-9))
        pairs = tables.save(pairs.select("seat", "shard"))
        met = now.join(pairs, "seat").withColumn("group", F.pmod(F.xxhash64(F.lit(3), "seat"), F.lit(groups)).cast("int"))
        used = shelves.join(pairs.select("shard").distinct(), "shard", "left_semi")
        return tables.save(V.meet(used, met, groups, "windows").mapInArrow(tidy(_visits(k, same)), LISTS))

    begun = round_(F.col("head"), asks, max(1, group_rows // 16))
    found = V.merged(begun, ["ask", "slot"], k, parts).groupBy("ask", "slot").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    floors = found.groupBy(F.col("ask").alias("seat")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("floors"))  # a slot a positive
    raised = F.transform("windows", lambda w: F.struct(w["slot"].alias("slot"), w["low"].alias("low"), w["high"].alias("high"), F.coalesce(F.try_element_at("floors", w["slot"]), w["floor"]).alias("floor")))
    rest = round_(~F.col("head"), asks.join(floors, "seat", "left").withColumn("windows", raised.cast(WINDOWS)).drop("floors"), group_rows)
    return tables.save(V.merged(begun.unionByName(rest), ["ask", "slot"], k, parts))


def mine(vectors: DataFrame, label: Column, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, from_percent: int = FROM_PERCENT, to_percent: int = TO_PERCENT,
         id_col: str = "vec_id", vector_col: str = "embedding", group_rows: int = V.GROUP_ROWS, shards: int | None = None) -> DataFrame:
    """The first negatives of every anchor (rows whose id `every` divides) and positive of it: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    tables = Tables(vectors.sparkSession, "negatives")
    rows = V.encoded(tables, vectors, id_col, vector_col, label)
    shards = shards or V.shard_count(rows)
    anchors = rows.filter(F.col("id") % every == 0)

    by_label = shelved(tables, rows, shards, F.col("label"), F.col("norm").desc())
    tops = by_label.groupBy("label", "shard").agg(F.max("norm").alias("top"))  # a row a label and shelf
    tops = tops.withColumn("head", F.row_number().over(Window.partitionBy("label").orderBy("shard")) == 1)  # ranges are in order of norm
    everything = F.array(F.struct(F.lit(0).alias("slot"), F.lit(V.LOW + 1).alias("low"), F.lit(V.HIGH).alias("high"), F.lit(V.LOW + 1).alias("floor"))).cast(WINDOWS)
    reach = anchors.select("seat", "label").join(tops, "label").select("seat", "shard", "top", "head")
    same = _search(tables, anchors.withColumn("windows", everything), by_label, reach, positives, True, group_rows)

    by_norm = shelved(tables, rows, shards, F.col("norm").desc())
    tables.drop(by_label)
    up = lambda a, b: -F.floor(-a / b)
    score = F.col("score").cast("decimal(20,0)")
    window = F.struct(F.col("rank").cast("int").alias("slot"), up(score * from_percent, F.lit(100)).cast("long").alias("low"), F.floor(score * to_percent / 100).cast("long").alias("high"), F.lit(V.LOW + 1).alias("floor"))
    windows = same.withColumn("w", window).filter("w.low <= w.high").groupBy(F.col("ask").alias("seat")).agg(F.collect_list("w").cast(WINDOWS).alias("windows"))  # as many as positives
    asks = tables.save(anchors.join(windows, "seat"))
    tops = by_norm.groupBy("shard").agg(F.max("norm").alias("top"))  # a row a shelf
    top_shard = by_norm.agg(F.min("shard")).first()[0]
    last = by_norm.agg(F.max("shard")).first()[0] or 0
    reach = asks.select("seat", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard")).join(tops, "shard").withColumn("head", F.col("shard") == F.lit(top_shard))
    other = _search(tables, asks, by_norm, reach, negatives, False, group_rows)

    named = same.join(anchors.select(F.col("seat").alias("ask"), F.col("id").alias("anchor_id")), "ask").select("ask", F.col("rank").alias("slot"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = other.join(named, ["ask", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, label = F.col("vec_id"), F.col("label").cast("long")
    return mine(read(spark, sf_dir, "embeddings"), F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label))


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

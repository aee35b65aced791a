"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of the lists.

Candidates are dealt into shards of bounded size, queries into groups; a task holds one shard and multiplies it with one
tile of queries after the other, in pieces of a bounded area. Of every piece only the k greatest scores of each query (and
their ties) leave the product by partial selection; the k first of a shard are a task's list. Lists are merged as a tree,
a bounded number at a time. Queries are a stated set against all rows; no pair leaves a task but those of the lists.

Defined cases: a vector that is null or holds a null or non-finite component, one whose scaled component no double can
hold, and a row with a null id take no part; vectors meet only vectors of their own length (empty ones score 0); rows
that repeat an id are rows of their own: each queries for itself, and only the row itself is left out; ties go to the
smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panweave.llm import _vectors as V
from panweave.llm._spark import Tables, read, tidy

K = 5
EVERY = 50
PIECE = 4096

LISTS = "ask long, query_id long, part int, seat long, id long, score long"


def tile_lists(shard: V.Rows, asks: V.Rows, k: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the candidate, score) of the first k candidates of a shard for every query of a tile."""
    owner, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(shard.id), piece):
        part = shard.take(slice(at, at + piece))
        scores = V.products(asks, part)
        scores[(asks.dim[:, None] != part.dim[None]) | (asks.seat[:, None] == part.seat[None])] = V.LOW
        i, j = V.contenders(scores, k)
        owner, place, score = np.concatenate((owner, i)), np.concatenate((place, j + at)), np.concatenate((score, scores[i, j]))
        best = V.first(owner, score, shard.id[place], shard.seat[place], k)
        owner, place, score = owner[best], place[best], score[best]
    return owner, place, score


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, asks in V.meetings(batches):
            owner, place, score = tile_lists(shard, asks, k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asks.seat[owner], asks.id[owner], np.full(len(owner), shard.shard, np.int32), shard.seat[place], shard.id[place], score)],
                                             names=["ask", "query_id", "part", "seat", "id", "score"])
    return run


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", group_rows: int = V.GROUP_ROWS) -> DataFrame:
    """The k best other rows of each query, the rows whose id `every` divides: query_id, rank, vec_id, score."""
    tables = Tables(vectors.sparkSession, "topk")
    rows = V.encoded(tables, vectors, id_col, vector_col)
    shards = V.shard_count(rows)
    asks = rows.filter(F.col("id") % every == 0)
    groups = max(1, -(-asks.count() // group_rows))
    answers = rows.withColumn("shard", F.pmod(F.xxhash64("seat"), F.lit(shards)).cast("int"))
    asks = asks.withColumn("group", F.pmod(F.xxhash64(F.lit(3), "seat"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    lists = V.meet(answers, asks, groups).mapInArrow(tidy(_tiles(k)), LISTS)
    best = V.merged(lists, ["ask", "query_id"], k, shards)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

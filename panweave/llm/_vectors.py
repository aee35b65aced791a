"""Whole-number vectors for exact inner-product search: encoding, shards and tiles, products, selection, merging.

A component x becomes floor(256 * x), x as double; a vector is stored as its 16-bit numbers where they all fit, else as
doubles. Products are exact: in double precision where no partial sum can pass 2**53 (by the product of the norms), with
Python's integers beyond that; a score that a long can't hold is set to the nearest long.

A task is one shard of candidates and one group of queries: the shard is held, the queries stream past it in tiles, so
memory is bounded by a shard and a tile. Shards are cut by their number of components, groups by their number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panweave.llm._spark import Tables, tidy

SCALE = 256.0
#: Components a shard holds at most, about: 32 MB as doubles. Queries that one task takes at most, about.
SHARD_VALUES, GROUP_ROWS = 1 << 22, 1 << 16
TILE = 256
FAN = 32
LOW = np.iinfo(np.int64).min
HIGH = np.iinfo(np.int64).max
_EXACT = float(1 << 53)

ROWS = "seat long, id long, label string, dim int, wide boolean, norm double, vector binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seat, id, label, components) -> ROWS; vectors whose numbers leave the doubles go."""
    for batch in batches:
        lists = batch.column(3)
        sizes = np.diff(lists.offsets.to_numpy())
        with np.errstate(over="ignore"):
            values = np.floor(SCALE * np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64))
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            parts = [values[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            norm = np.array([np.sqrt(np.dot(p, p)) for p in parts], np.float64)
        good = np.array([bool(np.isfinite(p).all()) for p in parts], bool)
        wide = np.array([bool(len(p)) and float(np.abs(p).max()) > 32767 for p in parts], bool)
        blobs = [p.tobytes() if w else p.astype(np.int16).tobytes() for p, w, g in zip(parts, wide, good, strict=True) if g]
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(keep) for i in range(3)), pa.array(sizes[good].astype(np.int32)), pa.array(wide[good]), pa.array(norm[good]), pa.array(blobs, pa.binary())],
                                         names=["seat", "id", "label", "dim", "wide", "norm", "vector"])


def encoded(tables: Tables, vectors: DataFrame, id_col: str, vector_col: str, label: Column | None = None) -> DataFrame:
    """The rows that take part, as a written table: seat numbers rows, so rows that repeat an id stay apart."""
    columns = [F.col(id_col).cast("long").alias("id"), (F.lit("") if label is None else label).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")]
    rows = vectors.select(*columns)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    return tables.save(rows.select(F.monotonically_increasing_id().alias("seat"), "id", "label", "v").mapInArrow(tidy(_encode), ROWS))


def shard_count(rows: DataFrame) -> int:
    """So many shards that none passes SHARD_VALUES components, and enough of 2,048 rows and more for every task slot."""
    n, values = rows.agg(F.count(F.lit(1)), F.sum(F.greatest("dim", F.lit(1)))).first()
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-(values or 0) // SHARD_VALUES), min(-(-n // 2048), slots))


def meet(candidates: DataFrame, queries: DataFrame, groups: int, *more: str) -> DataFrame:
    """Candidates (ROWS, shard) and queries (ROWS, shard, group, more) as tasks: each task's candidates, then its queries.

    A candidate stands once in every group, a query once in every shard that it names.
    """
    group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    names = ["seat", "id", "label", "dim", "wide", "norm", "vector", "shard", "group"]
    kinds = dict(queries.dtypes)
    left = candidates.select(*names[:-1], group).select(F.lit(0).alias("side"), *names, *[F.lit(None).cast(kinds[c]).alias(c) for c in more])
    right = queries.select(F.lit(1).alias("side"), *names, *more)
    both = left.unionByName(right).withColumn("task", F.col("shard").cast("long") * groups + F.col("group"))
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.drop("group").repartition(n, "task").sortWithinPartitions("task", "side")


@dataclass
class Rows:
    seat: np.ndarray
    id: np.ndarray
    label: np.ndarray
    dim: np.ndarray
    norm: np.ndarray
    matrix: np.ndarray
    shard: int
    table: pa.Table

    def take(self, at) -> Rows:
        return Rows(self.seat[at], self.id[at], self.label[at], self.dim[at], self.norm[at], self.matrix[at], self.shard, self.table)


def decoded(parts: list[pa.RecordBatch], width: int = 0) -> Rows:
    """Vectors as a matrix, shorter ones filled up with zeros (they never meet vectors of another length)."""
    table = pa.Table.from_batches(parts)
    dim, wide = table["dim"].to_numpy(), table["wide"].to_numpy()
    blobs = table["vector"].combine_chunks()
    matrix = np.zeros((len(dim), max(width, int(dim.max(initial=0)))), np.float64)
    for d, w in {*zip(dim.tolist(), wide.tolist(), strict=True)}:
        at = np.flatnonzero((dim == d) & (wide == w))
        if d:
            matrix[at, :d] = np.frombuffer(b"".join(blobs.take(pa.array(at)).to_pylist()), np.float64 if w else np.int16).reshape(len(at), d)
    label = table["label"].to_numpy(zero_copy_only=False).astype(object)
    return Rows(table["seat"].to_numpy(), table["id"].to_numpy(), label, dim, table["norm"].to_numpy(), matrix, table["shard"][0].as_py(), table)


def meetings(batches: Iterator[pa.RecordBatch], tile: int = TILE) -> Iterator[tuple[Rows, Rows]]:
    """(shard, tile of queries) for every task of a stream made by meet()."""
    task, held, shard, waiting, n = None, [], None, [], 0

    def pair() -> tuple[Rows, Rows]:
        nonlocal shard
        if shard is None:
            shard = decoded(held)
        asks = decoded(waiting, shard.matrix.shape[1])
        if asks.matrix.shape[1] > shard.matrix.shape[1]:
            shard.matrix = np.pad(shard.matrix, ((0, 0), (0, asks.matrix.shape[1] - shard.matrix.shape[1])))
        return shard, asks

    for batch in batches:
        if not batch.num_rows:
            continue
        key, side = batch.column("task").to_numpy(), batch.column("side").to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
            if key[lo] != task:
                if waiting:
                    yield pair()
                task, held, shard, waiting, n = key[lo], [], None, [], 0
            if not side[lo]:
                held.append(batch.slice(lo, hi - lo))
                continue
            while held and lo < hi:
                part = batch.slice(lo, min(hi - lo, tile - n))
                waiting.append(part)
                lo, n = lo + part.num_rows, n + part.num_rows
                if n >= tile:
                    yield pair()
                    waiting, n = [], 0
    if waiting:
        yield pair()


def products(asks: Rows, answers: Rows) -> np.ndarray:
    """All inner products of two sets of rows, exactly, as 64-bit integers."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = asks.norm[:, None] * answers.norm[None, :]
        plain = asks.matrix @ answers.matrix.T
    far = ~(bound < _EXACT)
    plain[far] = 0
    out = plain.astype(np.int64)
    if far.any():
        i, j = np.flatnonzero(far.any(axis=1)), np.flatnonzero(far.any(axis=0))
        whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
        exact = np.dot(whole(asks.matrix[i]), whole(answers.matrix[j]).T) if asks.matrix.shape[1] else np.zeros((len(i), len(j)), object)
        held = np.array([max(LOW + 1, min(HIGH, int(x))) for x in exact.ravel()], np.int64).reshape(len(i), len(j))
        out[np.ix_(i, j)] = np.where(far[np.ix_(i, j)], held, out[np.ix_(i, j)])
    return out


def contenders(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of every row's k greatest scores, with all ties of the last one; LOW stands for no candidate."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), LOW)
    return np.nonzero((scores >= least[:, None]) & (scores > LOW))


def first(owner: np.ndarray, score: np.ndarray, id: np.ndarray, seat: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's first k by greater score, then smaller id."""
    order = np.lexsort((seat, id, -score, owner))
    own = owner[order]
    start = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
    rank = np.arange(len(own)) - np.maximum.accumulate(np.where(start, np.arange(len(own)), 0))
    return order[rank < k]


def merged(lists: DataFrame, by: list[str], k: int, parts: int, fan: int = FAN) -> DataFrame:
    """Top lists of `parts` parts (column part) merged as a tree: `fan` lists at a time, to the first k of every `by`.

    No window sees more than fan * k rows. Adds rank.
    """
    order = [F.col("score").desc(), "id", "seat"]
    while True:
        parts = -(-parts // fan)
        lists = lists.withColumn("part", F.floor(F.col("part") / fan).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order))).filter(F.col("rank") <= k)
        if parts <= 1:
            return lists.drop("part")
        lists = lists.drop("rank")

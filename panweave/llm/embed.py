"""Embedding near-dedup by collision counting over sorted one-dimensional projections.

Every unit vector is projected on M random directions. For a pair at the threshold the difference of each projection is
normal with standard deviation d = sqrt(2 - 2 * cosine), so it lies in the window of half-width q * d around the query
vector with a known probability, and the number of windows in which a pair collides is binomial. A pair is verified if
it collides in at least M - MISSES projections; q is the smallest half-width for which a pair exactly at the threshold
reaches that count with probability RECALL. Closer pairs collide more often.

Counting every window collision would touch a share of all pairs in each projection. The directions are therefore split
into MISSES + 1 groups: a pair that misses at most MISSES windows has all windows of at least one group, so looking at
pairs which collide in a whole group finds all pairs that reach the count, and the count itself is then taken over all
M projections. Groups are searched by a grid over their first few projections (cells of twice the window; a vector also
goes into the next lower cell where its window reaches over the border) and by sorted windows within a cell; a cell of
many vectors is cut into blocks, and tasks compare two blocks. A pair is counted once: in the first group, and there in
the one cell, that holds it. Tasks return sums of links per vector and a forest of the links, never pairs.

Vectors and projections are written once. Placing vectors in cells and cells in blocks moves only numbers; the vectors
join the tasks by their class at the end, so each travels once a group and block that needs it.

Cosines are computed in double precision from the stored components (of either width). Equal vectors of a label are one
class from the start, with its size as weight.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
link with nothing; vectors of different lengths don't link; a null vec_id can't be named, so such a row links with
nothing, has a null component and isn't kept; rows that repeat a vec_id count as separate vectors; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panweave.llm._graph import components, settle
from panweave.llm._spark import Tables, keyed_streams, read, runs, tidy

COSINE = 0.98
PROJECTIONS, MISSES = 32, 3
RECALL = 0.9995
BLOCK = 2048
SEED = 11


def calibrate(projections: int, misses: int, recall: float) -> float:
    """The half-width q, in standard deviations of the difference, at which a pair at the threshold is verified."""
    def reached(q: float) -> float:
        miss = math.erfc(q / math.sqrt(2))
        return sum(math.comb(projections, k) * miss**k * (1 - miss) ** (projections - k) for k in range(misses + 1))

    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if reached(mid) >= recall else (mid, hi)
    return hi


def grid_dims(largest: int, window: float, group: int) -> int:
    """How many projections of a group the grid uses: each leaves about this share of the vectors in the fullest cell."""
    share = max(0.05, math.erf(window / math.sqrt(2)))
    return max(1, min(group, math.ceil(math.log(max(1.0, largest / BLOCK)) / -math.log(min(share, 0.9)))))


def _project(dim_seed: int, projections: int, groups: int, dims: int, window: float, width: type):
    """Rows (node, label, weight, vector) -> vector and projections as bytes, and the cells of every group."""
    size = projections // groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(3)
            lengths = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                flat = np.concatenate([np.asarray(vectors[int(i)].values.to_numpy(zero_copy_only=False), width) for i in at]).reshape(len(at), dim)
                if dim not in made:
                    made[dim] = np.random.default_rng([dim_seed, dim]).standard_normal((dim, projections))
                exact = flat.astype(np.float64)
                scale = np.abs(exact).max(axis=1, keepdims=True)
                unit = exact / scale
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                proj = (unit @ made[dim]).astype(np.float32)
                node, label, weight = (batch.column(i).take(pa.array(at)) for i in range(3))
                blobs = pa.array([v.tobytes() for v in flat], pa.binary())
                marks = pa.array([v.tobytes() for v in proj], pa.binary())
                row, group, cells = [], [], []
                for g in range(groups):
                    own = proj[:, g * size : g * size + dims].astype(np.float64)
                    home, low = np.floor(own / (2 * window)).astype(np.int64), np.floor((own - window) / (2 * window)).astype(np.int64)
                    for mask in range(1 << dims):
                        lower = np.array([(mask >> d) & 1 for d in range(dims)], bool)
                        there = np.where(lower, low, home)
                        keep = np.flatnonzero(((low < home) | ~lower).all(axis=1))
                        row.append(keep)
                        group.append(np.full(len(keep), g, np.int32))
                        cells.append(there[keep])
                row, group, cells = np.concatenate(row), np.concatenate(group), np.concatenate(cells)
                order = np.argsort(row, kind="stable")
                cell = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * dims), pa.array(cells[order].ravel()))
                spots = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(len(at) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(group[order]), cell], names=["grp", "cell"]))
                yield pa.RecordBatch.from_arrays([node, label, weight, pa.array(np.full(len(at), dim, np.int32)), blobs, marks, spots], names=["node", "label", "weight", "dim", "vector", "marks", "spots"])
    return run


MARKED = "node long, label string, weight long, dim int, vector binary, marks binary, spots array<struct<grp:int,cell:array<long>>>"


def _pairs(proj: np.ndarray, asks: np.ndarray, answers: np.ndarray, g: int, size: int, window: float, misses: int, home: np.ndarray, dims: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two blocks that collide in all of group g, in no whole group before it, and reach the count."""
    lo, hi = g * size, (g + 1) * size
    line = hi - 1  # windows are sorted along a projection that the grid doesn't use, if there is one
    order = answers[np.argsort(proj[answers, line], kind="stable")]
    values = proj[order, line]
    cell = home
    for part in range(0, len(asks), 128):
        rows = asks[part : part + 128]
        rows = rows[np.argsort(proj[rows, line], kind="stable")]
        begin = np.searchsorted(values, proj[rows[0], line] - window, "left")
        end = np.searchsorted(values, proj[rows[-1], line] + window, "right")
        near = order[begin:end]
        if not len(near):
            continue
        hit = np.abs(proj[rows, lo][:, None] - proj[near, lo][None]) <= window
        i, j = np.nonzero(hit)
        for k in range(lo + 1, hi):
            ok = np.abs(proj[rows[i], k] - proj[near[j], k]) <= window
            i, j = i[ok], j[ok]
        a, b = rows[i], near[j]
        if same:
            once = a < b
            a, b = a[once], b[once]
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            meet = np.abs(proj[x] - proj[y]) <= window
            good = meet.sum(axis=1) >= proj.shape[1] - misses
            for earlier in range(g):
                good &= ~meet[:, earlier * size : (earlier + 1) * size].all(axis=1)
            # the cell of a pair is the lower one of the two home cells, along each axis
            lower = np.minimum(np.floor(proj[x, lo : lo + dims].astype(np.float64) / (2 * window)), np.floor(proj[y, lo : lo + dims].astype(np.float64) / (2 * window)))
            good &= (lower == cell[None]).all(axis=1)
            yield x[good], y[good]


def _links(cosine: float, projections: int, groups: int, misses: int, dims: int, window: float, width: type):
    size = projections // groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "task", BLOCK):
            task = table["task"].to_numpy()
            node, weight, grp, dim = (table[c].to_numpy() for c in ("node", "weight", "grp", "dim"))
            first, second = table["asks"].to_numpy(), table["answers"].to_numpy()
            cells, vectors, marks = table["cell"], table["vector"].combine_chunks(), table["marks"].combine_chunks()
            cuts = np.concatenate(([0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]))
            out_node, out_n, out_root = [], [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                rows = hi - lo
                proj = np.frombuffer(b"".join(marks.slice(lo, rows).to_pylist()), np.float32).reshape(rows, projections).astype(np.float64)
                exact = np.frombuffer(b"".join(vectors.slice(lo, rows).to_pylist()), width).reshape(rows, int(dim[lo])).astype(np.float64)
                exact = exact / np.abs(exact).max(axis=1, keepdims=True)
                norm = np.sqrt((exact * exact).sum(axis=1))
                asks, answers = np.flatnonzero(first[lo:hi]), np.flatnonzero(second[lo:hi])
                same = len(asks) == len(answers) == rows
                a, b, n = [], [], np.zeros(rows, np.int64)
                for x, y in _pairs(proj, asks, answers, int(grp[lo]), size, window, misses, np.array(cells[lo].as_py()), dims, same):
                    for at in range(0, len(x), 1 << 15):
                        p, q = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
                        good = (exact[p] * exact[q]).sum(axis=1) / (norm[p] * norm[q]) >= cosine
                        p, q = p[good], q[good]
                        np.add.at(n, p, weight[lo:hi][q])
                        np.add.at(n, q, weight[lo:hi][p])
                        a.append(p)
                        b.append(q)
                if a and n.any():
                    root = settle(rows, np.concatenate(a), np.concatenate(b))
                    some = np.flatnonzero(n)
                    out_node.append(node[lo:hi][some])
                    out_n.append(n[some])
                    out_root.append(node[lo:hi][root[some]])
            if out_node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (out_node, out_n, out_root)], names=["node", "n", "root"])
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, projections: int = PROJECTIONS, misses: int = MISSES, recall: float = RECALL, seed: int = SEED, block: int = BLOCK, dims: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    tables = Tables(spark, "embed")
    groups = misses + 1
    if projections % groups:
        raise ValueError("projections must be a multiple of misses + 1")
    window = calibrate(projections, misses, recall) * math.sqrt(2 - 2 * cosine)

    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    kind, width = ("float", np.float32) if single else ("double", np.float64)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # 0 and -0 are equal components
    plain = F.when(usable, F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)))
    rows = rows.select("vec_id", "label", plain.alias("v"))
    key = [F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit(1), "v", "label").alias("k2")]
    narrow = rows.select("vec_id", *[F.when(F.col("v").isNotNull(), k).alias(n) for k, n in zip(key, ("k1", "k2"), strict=True)])
    classes = tables.save(rows.filter("v IS NOT NULL").select("vec_id", "label", "v", *key).groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id()))
    if dims is None:
        largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        dims = grid_dims(largest, window, projections // groups)

    marked = tables.save(classes.select("node", "label", "weight", "v").mapInArrow(tidy(_project(seed, projections, groups, dims, window, width)), MARKED))
    cell = ["label", "dim", "grp", "cell"]
    placed = marked.select("node", "label", "dim", F.explode("spots").alias("s")).select("node", "label", "dim", "s.grp", "s.cell").withColumn("spot", F.xxhash64(*cell))
    load = placed.select("spot").groupBy("spot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("p", F.ceil(F.col("n") / block).cast("int"))
    part = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("p")).cast("int")
    spread = placed.join(load.select("spot", "p"), "spot").withColumn("i", part)
    # block i asks the blocks from its own on; a row stands once in each task that has its block
    roles = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda j: F.struct(
        F.least("i", j).alias("x"), F.greatest("i", j).alias("y"), (F.col("i") <= j).alias("asks"), (F.col("i") >= j).alias("answers")))
    tasks = spread.withColumn("t", F.explode(roles)).select(
        F.xxhash64(*cell, "t.x", "t.y").alias("task"), "node", "grp", "cell", "t.asks", "t.answers")
    tasks = tasks.join(marked.select("node", "weight", "dim", "vector", "marks"), "node")
    found = tables.save(keyed_streams(tasks, "task").mapInArrow(tidy(_links(cosine, projections, groups, misses, dims, window, width)), "node long, n long, root long"))

    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(tables, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = parts.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    parts = parts.join(least, "component").select("node", "component_id")
    known = classes.select("k1", "k2", "node", "rep", "weight").join(counts, "node", "left").join(parts, "node", "left").select(
        "k1", "k2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = narrow.join(known, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT node AS vec_id, min(seen) AS component_id FROM r GROUP BY ALL)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN m ON m.vec_id = e.vec_id
"""

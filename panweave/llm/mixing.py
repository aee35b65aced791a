"""Mixing sources to target weights: systematic sampling, in DataFrame functions only.

Sources weigh 5, 2, 1, repeating, in code point order (null last). Together they get `total` times all words; no source
gets more than `cap` times its own words, and what it can't take is shared again by weight. The fixed point of that
resharing is min(cap * size, level * weight) with one common level, found from prefix sums over the sources sorted by
the level at which they fill up.

Inside a source every document expects target / source_size copies. Documents stand in order of size, so that each
stretch of sizes gives its share; the running sum of expected copies plus one random offset of the source is cut at
integers, and a document comes once per integer that its own stretch crosses. Copies per document differ by one at
most, and a source misses its target by about one document.

The running sum is rank times rate, and the rank comes from levels: counts of small cells (source, leading digits of the
size and of the id's hash) give offsets, counts of equal ids and sizes inside a cell the next, and a row number the rest.
No task sees a whole source. The sources themselves, one row each, are ranked in one task.

Defined cases: null or wordless texts have size 0 and are taken 0 times; a null source is a source of its own, last;
repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.llm._spark import WORD, Tables, read, source_key

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
CAP = 2
SEED = "mix-1"
TIES = 64


def source_targets(sources: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: int = CAP) -> DataFrame:
    """(skey, source, source_size) -> with target and rate. One row a source, so the two windows see only that."""
    place = (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    s = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    s = s.withColumn("full", (F.col("source_size") * cap).cast("double"))
    s = s.withColumn("fill", F.col("full") / F.col("w"))
    order = W.orderBy("fill", F.asc_nulls_last("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumns({
        "left": F.lit(float(total)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0)),
        "left_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    s = s.withColumn("level_here", F.col("left") / F.col("left_w"))
    s = s.withColumn("open", F.col("fill") > F.col("level_here"))
    s = s.withColumn("level", F.min(F.when(F.col("open"), F.struct("fill", "level_here"))).over(everything)["level_here"])
    s = s.withColumn("target", F.when(F.col("open"), F.col("level") * F.col("w")).otherwise(F.col("full")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.select("skey", "source", "source_size", "target", rate.alias("rate"))


def offset(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the seed and the source: 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def plan(tables: Tables, rows: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """rows(_row, _id, _size, _source), a written table -> with source_size, target, copies and taken.

    Documents of one id and size in one source are interchangeable; they are counted in TIES parts by their number, so
    that a repeated row is no single task's work either.
    """
    sizes = rows.withColumns({"skey": source_key("_source"), "mark": F.md5(F.coalesce(F.col("_id").cast("string"), F.lit(""))), "tie": F.pmod("_row", F.lit(TIES))})
    sources = sizes.groupBy("skey").agg(F.first("_source", ignorenulls=True).alias("source"), F.sum("_size").alias("source_size"))
    targets = tables.save(source_targets(sources, weights, total, cap))

    # Ranks in three levels: rows before a cell (leading digits of the size, leading digits of the id's hash), those
    # before a tie in its cell, and the row's number in its tie.
    tie, cell = ["skey", "_size", "mark", "tie"], ["skey", "len", "lead", "salt"]
    digits = F.col("_size").cast("string")
    ties = sizes.groupBy(*tie).agg(F.count(F.lit(1)).alias("n")).withColumns({"len": F.length(digits), "lead": F.substring(digits, 1, 2), "salt": F.substring("mark", 1, 2)})
    ties = tables.save(ties.withColumn("begin", F.sum("n").over(W.partitionBy(*cell).orderBy("_size", "mark", "tie").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")))
    counts = ties.groupBy(*cell).agg(F.sum("n").alias("n"))
    before = W.partitionBy("skey").orderBy("len", "lead", "salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("cell_begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    starts = ties.join(starts, cell).select(*tie, (F.col("begin") + F.col("cell_begin")).alias("begin"))
    ranked = sizes.withColumn("within", F.row_number().over(W.partitionBy(*tie).orderBy("_row")) - 1).join(starts, tie).join(targets, "skey")
    place = (F.col("begin") + F.col("within")).cast("double")
    shift = offset(F.col("skey"), seed)
    copies = F.floor(F.col("rate") * (place + 1.0) + shift) - F.floor(F.col("rate") * place + shift)
    copies = F.when(F.col("_size") > 0, copies).otherwise(F.lit(0)).cast("long")
    return ranked.select("_row", "_id", "_size", "_source", "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return [F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), size.alias("_size"), F.col(source_col).cast("string").alias("_source")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies, taken."""
    tables = Tables(docs.sparkSession, "mix")
    rows = tables.save(docs.select(*_sized(docs, id_col, text_col, source_col)))
    return plan(tables, rows, **options).select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source").alias("source"), "source_size", "target", "copies", "taken")


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus itself: the rows of `docs`, each as often as it is taken, with their own columns.

    The rows are written once with a number and their size. The plan reads those narrow columns alone, and the rows meet
    their number of copies in one join.
    """
    tables, columns = Tables(docs.sparkSession, "mix"), docs.columns
    # a row's own columns travel as one struct, so that their names can't clash with the plan's
    rows = tables.save(docs.select(*_sized(docs, id_col, text_col, source_col), F.struct(*[F.col(c) for c in columns]).alias("_doc")))
    taken = plan(tables, rows.select("_row", "_id", "_size", "_source"), **options).filter("copies > 0").select("_row", "copies")
    out = rows.select("_row", "_doc").join(taken, "_row")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
s1 AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s0),
s2 AS (SELECT *, (2 * source_size)::DOUBLE AS cap, (2 * source_size)::DOUBLE / w AS fill FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS here
       FROM s2 WINDOW o AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT skey, source_size, CASE WHEN fill > here THEN (SELECT arg_min(here, fill) FROM s3 WHERE fill > here) * w ELSE cap END AS target FROM s3),
r AS (SELECT d.*, s.source_size, s.target, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS rate,
        (row_number() OVER (PARTITION BY skey ORDER BY length(size::VARCHAR), substr(size::VARCHAR, 1, 2), substr(md5(doc_id::VARCHAR), 1, 2), size, md5(doc_id::VARCHAR)) - 1)::DOUBLE AS k,
        ('0x' || substr(md5('mix-1' || skey), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM d JOIN s USING (skey))
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN (floor(rate * (k + 1) + u) - floor(rate * k + u))::BIGINT * size ELSE 0 END AS taken
FROM r
"""

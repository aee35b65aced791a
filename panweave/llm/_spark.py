"""Reading, grouping keys and grouped streaming for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panweave.tables import Tables  # noqa: F401  the operators here take it from this module

#: Words are runs of anything but space and the five ASCII controls 0x09-0x0D (RE2 and java.util.regex agree on it).
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that gives freed memory back at the end of a task.

    Workers are reused and idle beside the JVM's later stages, so what their allocators keep would count against those.
    """
    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole runs of equal `key` from a stream sorted by it.

    Small runs come many at a time, so that the cost of a call is shared; a run never comes apart. Callers bound the
    size of a run before (blocks), so memory is bounded by the larger of a run and `rows` rows plus a batch.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key)
        if n + batch.num_rows >= rows or held and n >= rows:
            last = keys[-1].as_py()
            at = batch.num_rows
            while at and keys[at - 1].as_py() == last:
                at -= 1
            if at or (held and held[-1].column(key)[-1].as_py() != last):
                if at:
                    held.append(batch.slice(0, at))
                yield pa.Table.from_batches(held)
                held, n = [batch.slice(at)], batch.num_rows - at
                continue
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def keyed_streams(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key together and in order, for runs(); the keys are dealt by their hash."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key)


def source_key(column: str):
    """A grouping key for a nullable string that keeps null apart from every string and never is null itself."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))

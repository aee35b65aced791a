"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder set by setCheckpointDir(); a temporary folder only where neither is set and
    driver and executors are one process."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if place:
        return place.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _temporary()


@functools.cache
def _temporary() -> str:
    place = tempfile.mkdtemp(prefix="panweave-")
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    return place


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Intermediate tables written as Parquet to the shared folder: they cut lineage and outlive executors.

    A table that a result still reads stays until the application ends; the others go with drop().
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/panweave-{label}-{uuid.uuid4().hex}", 0
        if not _written:
            atexit.register(_clean)
        _written.append((spark, self.root))

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._panweave_path = path
        return out

    def folder(self, name: str) -> str:
        """A folder of this label's own for other files, removed with its tables when the application ends."""
        return f"{self.root}/{name}"

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _remove(self.spark, t._panweave_path)

    def clear(self) -> None:
        """Removes all tables and folders of this label; for work whose result lies elsewhere."""
        _remove(self.spark, self.root)


def _clean() -> None:
    for spark, root in _written:
        try:
            _remove(spark, root)
        except Exception:  # noqa: BLE001  the session may have gone
            return

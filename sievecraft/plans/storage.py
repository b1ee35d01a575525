"""Shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A folder of our own only where it is unset and Spark runs in this machine alone, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='sievecraft-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []
#: A small table in hundreds of files costs more by its files than by its rows.
BYTES_A_FILE = 32 << 20


def files_for(df: DataFrame, least: int = 8) -> int:
    """How many files suit rows as large as df's, by the optimiser's estimate of its size; an estimate too high does no harm."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return min(1 << 30, max(least, int(str(size)) // BYTES_A_FILE))


def written(df: DataFrame, tag: str, compact: bool = False, files: int | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends there, and lost executors cost no recomputation.

    compact: narrow rows go through a shuffle that AQE brings to partitions of a good size, so that they make few files. files: the most files that
    are written, where there are more tasks than that (see files_for).
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if compact else df
    df = df if files is None else df.coalesce(files)
    path = scratch(spark, tag)
    for scope in _scopes:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths that written() makes inside the block, for remove_path once no later result reads them."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.remove(paths)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _hadoop(spark, path)
    return fs.exists(where)


def path_names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if it is not there."""
    fs, where = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Renames path, which takes the place of anything at `to`."""
    fs, where = _hadoop(spark, path)
    remove_path(spark, to)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"cannot rename {path} to {to}")


def remove_path(spark: SparkSession, path: str) -> None:
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if a count shows that it has at most max_rows rows; else df, for a sort-merge join that AQE may split."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df

"""Intermediate tables in the folder the cluster shares.

A written table ends the lineage, outlives lost executors, is computed once however often it is
read, and has a size Catalyst knows: a join against it is broadcast only when its files are below
``spark.sql.autoBroadcastJoinThreshold``, and is a sort-merge join otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_paths: list[str] = []
# Spark deletes the shuffle files of a query when it ends, not when its plan is collected as garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder given to ``setCheckpointDir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, lookup: bool = False) -> DataFrame:
    """Write ``df`` once and hand back a reader of the written table.

    A ``lookup`` is a table others join against. It is stored without compression and dictionaries,
    so that its file size is the size of its values: repeated symbols would otherwise shrink to a
    file that passes for broadcastable and is not. The files of its shuffles are deleted once it is written.
    """
    path = new_path(df.sparkSession, name)
    plain = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}
    with _shuffles_deleted(df.sparkSession):
        df.write.options(**(plain if lookup else {})).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def mark() -> int:
    """A point in time, for ``drop_since``."""
    return len(_paths)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing still to run reads: what ``written`` returned, not what was made of it."""
    for table in tables:
        if table is not None and table.written_to in _paths:
            _paths.remove(table.written_to)
            _delete(table.sparkSession, table.written_to)


def drop_since(spark: SparkSession, start: int, *keep: DataFrame) -> None:
    """Delete what was written after ``mark`` gave ``start``, but for ``keep``; lets go of shuffle files, too.

    Spark deletes a shuffle's files when its plan is collected as garbage, which may take long by itself.
    """
    kept = {table.written_to for table in keep}
    for path in [p for p in _paths[start:] if p not in kept]:
        _paths.remove(path)
        _delete(spark, path)
    spark._jvm.System.gc()


def drop_written(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process; only once nothing reads them any more."""
    while _paths:
        _delete(spark, _paths.pop())

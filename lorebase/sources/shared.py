"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task gets about where dealt() deals them.
ROWS_PER_TASK = 500_000
#: Documents that a task gets about where they are parsed.
DOCS_PER_TASK = 50_000

#: The setting by which Spark deletes the shuffle files of a query that has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one local process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lorebase-"))
    return _own[0]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cut off from its lineage, and a lost executor loses nothing of it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def no_shuffle_files_left(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a write inside as it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def dealt(df: DataFrame, rows: int, *keys: str, per_task: int | None = None) -> DataFrame:
    """df by keys over as many partitions as rows ask for, so that a task's share doesn't grow with the table, whatever the session's number of
    partitions. Rows for up to eight tasks are left to Spark. Sides of a join are to be dealt by the same rows."""
    parts = rows // (per_task or ROWS_PER_TASK)
    return df.repartition(parts, *keys) if parts > 8 else df

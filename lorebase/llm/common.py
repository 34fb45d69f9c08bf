"""What the operators of this package share: the folder that all executors see, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value: its complement, for split() and replace().
SPACES = r"[\x20\x09-\x0D]+"

#: The setting by which Spark deletes the shuffle files of a query that has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows up to which a table is broadcast.
FEW = 500_000
_own_dir: list[str] = []
#: The list that materialize() adds paths to, of this thread or task alone.
_recording: ContextVar[list[str] | None] = ContextVar("recording", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one local process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lorebase-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut and a lost executor loses nothing. Spark deletes the
    write's shuffle files as it ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if (paths := _recording.get()) is not None:
        paths.append(path)
    with _no_shuffle_files_left(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _no_shuffle_files_left(spark: SparkSession) -> AbstractContextManager[None]:
    return _setting(spark, _CLEANUP, "true")


def no_dictionary(spark: SparkSession) -> AbstractContextManager[None]:
    """Parquet files written inside have no dictionaries: among hashes, looking for repeated values is in vain."""
    return _setting(spark, "parquet.enable.dictionary", "false")


def few(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, broadcast where it has few rows; else joins with it shuffle."""
    return F.broadcast(df) if df.count() <= (FEW if limit is None else limit) else df


def drop_table(*tables: DataFrame) -> None:
    """Removes the files of materialized tables that nothing will read again."""
    for df in tables:
        drop_paths(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def drop_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Gathers the paths of the tables that are materialized inside."""
    paths: list[str] = []
    before = _recording.set(paths)
    try:
        yield paths
    finally:
        _recording.reset(before)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

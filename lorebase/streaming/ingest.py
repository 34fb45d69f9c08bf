"""Streaming ingest (S6, K2, X1, X7): change-only versioning with state, and evidence sinks.

Order is arrival: observed_at is when a row came, so there is no late data and no watermark. State is one small row an
object (seq, hash, deleted) in RocksDB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import identity
from ..operators.versions import OBJECT, ORDER, with_identity
from ..sources.sinks import write_batch

VERSIONED = "cluster_id string, object_id string, observed_at timestamp, observation_type string, doc_hash string, doc string, content_changed boolean, seq bigint"


class Versioning(StatefulProcessor):
    """V1, V2 per object; rows of one micro-batch are taken in the order of ORDER."""

    def __init__(self, readd_versions: bool):
        self.readd = readd_versions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("object", "seq bigint, hash string, deleted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        df = pd.concat(list(rows)).sort_values(list(ORDER), kind="stable")
        seq, last, deleted = self.state.get() if self.state.exists() else (0, None, False)
        marks = []
        for kind, h in zip(df["observation_type"], df["doc_hash"], strict=True):
            new = kind == "DELETED" or last is None or h != last or (self.readd and deleted)
            seq, last, deleted = seq + new, h, kind == "DELETED"
            marks.append((bool(new), int(seq)))
        self.state.update((int(seq), last, bool(deleted)))
        df["content_changed"], df["seq"] = [m[0] for m in marks], [m[1] for m in marks]
        yield df[[c.split()[0] for c in VERSIONED.split(", ")]]

    def close(self) -> None:
        pass


def version_stream(observations: DataFrame, readd_versions: bool = False) -> DataFrame:
    """Streaming rows with content_changed and seq, the same answer as operators.versions.changed() over all rows."""
    keyed = with_identity(observations).select(*OBJECT, "observed_at", "observation_type", "doc_hash", "doc")
    return keyed.groupBy(*OBJECT).transformWithStateInPandas(Versioning(readd_versions), VERSIONED, "append", "None")


def watch(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Observation files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def run_available(stream: DataFrame, root: str, checkpoint: str, tables_of: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
    """Writes all that is there now. A micro-batch's files are named by its number, so a rerun after a failure replaces them."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        write_batch(tables_of(batch), root, str(number))
        batch.unpersist()

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_identity(observations: DataFrame) -> DataFrame:
    return observations.withColumn("identity", identity.stream_identity())

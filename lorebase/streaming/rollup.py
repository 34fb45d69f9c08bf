"""Hourly counts of filter decisions as a stream (X9, A11): windows with a watermark, in update mode, into a keyed table of the store.

A micro-batch gives the counts, so far, of the hours that it changed; they take the place of what the table had. Each is a commit by
its number, so one that runs again changes nothing. Decisions later than the watermark's delay behind the newest are left out of the
counts, as the state of their hour is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import KEYED, Keyed, Store, upserted

KEYS = ("cluster_id", "filter_name", "outcome", "reason")
HOURLY = {"hourly_counts": Keyed(KEYED["filter_rollup"].schema, ("hour", *KEYS), upserted)}


def hourly_store(spark, root: str) -> Store:
    """The store that has the table hourly_counts."""
    return Store(spark, root, keyed=HOURLY)


def rollup_stream(decisions: DataFrame, root: str, checkpoint: str, delay: str = "2 hours") -> None:
    """Counts all decisions (ts and KEYS) that are there now; a second call goes on from the checkpoint."""
    windows = decisions.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), *KEYS)
    counts = windows.agg(F.count("*").alias("decisions"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    store = hourly_store(decisions.sparkSession, root)

    def put(batch: DataFrame, number: int) -> None:
        store.commit(number, {"hourly_counts": batch.select(F.col("w.start").alias("hour"), *KEYS, "decisions", "first_at", "last_at")})

    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

"""List-then-watch ingest (K9, S5, S7, X1-X3): a listed snapshot, the watch events behind it, and offset rows for each step of a stream.

A stream is a resource of a cluster. Each batch is one commit of all tables to the store of a folder: the list is batch 0 and micro-batch n is
n + 1; a batch that is committed already is left out when it comes again. Versioning goes on from object_state, a small row for each object,
of which a batch reads the buckets that its own objects fall into.
"""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..operators.versions import latest, raw_latest, relist_deletes
from ..schema import TABLES, Tables, empty
from ..sources.documents import decode, observations, read_documents, split_bookmarks
from ..sources.sinks import coalesced_offsets
from ..sources.store import Store
from ..streaming.ingest import watch
from .ingest import ingest

STREAM = ["cluster_id", "api_group", "resource"]
_KIND = ["api_version", "kind"]
WATCHED = "cluster_id string, observed_at timestamp, value string"

# What the text of an error says about the stream.
EXPIRED = ["too old", "expired", "410 gone", "status 410", "status code 410"]
TRANSIENT = [
    "unable to decode an event from the watch stream", "stream error:", "internal_error", "http2:", "received from peer", "connection reset by peer", "broken pipe",
    "unexpected eof", "server closed", "use of closed network connection", "transport is closing", "client connection lost",
]


def ingest_path(spark: SparkSession, path: str, cluster_id: str = "", cluster_part: int | None = None, observed_at: datetime | None = None, **options) -> Tables:
    """K9: evidence tables of a JSON file or of all JSON files below a folder; options go to ingest()."""
    decoded, _ = split_bookmarks(read_documents(spark, path, cluster_part))
    return ingest(observations(decoded, observed_at=None if observed_at is None else F.lit(observed_at), cluster_id=cluster_id), **options)


def offset_rows(rows: DataFrame, event: str, namespace: str = "", status: str = "ok") -> DataFrame:
    """An ingestion_offsets row for each stream in rows: the newest row's version and time. Rows of one time go by their version's number of digits, then its text."""
    last = F.struct("observed_at", F.length("resource_version"), "resource_version")
    new = lambda c: F.max_by(c, last).alias(c)
    seen = rows.groupBy(*STREAM).agg(*map(new, [*_KIND, "resource_version"]), (F.max("namespace") != "").alias("namespaced"), F.max("observed_at").alias("updated_at"))
    return _offsets(seen.withColumns({"namespace": F.lit(namespace), "event": F.lit(event), "status": F.lit(status), "error": F.lit("")}))


def _offsets(rows: DataFrame) -> DataFrame:
    at = lambda *events: F.when(F.col("event").isin(*events), F.col("updated_at"))
    rows = rows.withColumns({"last_list_at": at("listed"), "last_watch_at": at("watch", "bookmark"), "last_bookmark_at": at("bookmark")})
    return rows.select(*(c.strip().split()[0] for c in TABLES["ingestion_offsets"].split(",")))


def list_once(streams: DataFrame, listed: DataFrame, previous: DataFrame, at: datetime, namespace: str = "") -> tuple[DataFrame, DataFrame]:
    """(observations, offsets) of a list at a time.

    streams (cluster_id, api_group, resource, api_version, kind, namespaced, resource_version) are those that were listed; one without
    rows in listed has no objects left. Live objects among the previous observations that the list no longer has come as deletions with
    their last document; with a namespace, those of others stay.
    """
    live = raw_latest(previous.withColumn("object_id", identity.logical_id()).withColumn("seq", F.lit(0))).join(streams.select(*STREAM), STREAM, "left_semi")
    gone, _ = relist_deletes(live, listed, namespace)
    deleted = gone.withColumn("observed_at", F.lit(at)).select(*listed.columns)
    marks = streams.withColumns({"namespace": F.lit(namespace), "event": F.lit("listed"), "status": F.lit("ok"), "error": F.lit(""), "updated_at": F.lit(at)})
    return listed.unionByName(deleted), _offsets(marks)


def watch_failures(offsets: DataFrame, errors: DataFrame) -> DataFrame:
    """An offset row for each error (cluster_id, api_group, resource, namespace, error, updated_at) of a known stream, which keeps its
    version. An expired version or a broken connection is retried, other errors are told as such."""
    known = latest(offsets, *STREAM, "namespace", order=("updated_at", "event")).drop("error", "updated_at", "event", "status")
    status = F.when(_says("error", EXPIRED) | _says("error", TRANSIENT), "retrying").otherwise("watch_error")
    return _offsets(errors.join(known, [*STREAM, "namespace"]).withColumns({"event": F.lit("watch"), "status": status}))


def resume_points(offsets: DataFrame) -> DataFrame:
    """Where each stream goes on: a watch from its version; a list where that is unknown or the newest row says it has expired."""
    newest = latest(offsets, *STREAM, "namespace", order=("updated_at", "event"))
    relist = (F.col("resource_version") == "") | ((F.col("status") == "retrying") & _says("error", EXPIRED))
    return newest.select(*STREAM, "namespace", F.when(relist, "list").otherwise("watch").alias("next"), F.when(relist, "").otherwise(F.col("resource_version")).alias("resource_version"))


def _says(column: str, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.lower(column).contains(w)
    return found


def ingest_batch(spark: SparkSession, root: str, number: int, rows: DataFrame, offsets: DataFrame, readd_versions: bool = True) -> bool:
    """Commits the evidence of a batch of observations, with versions that go on from the batches before it, and its offset rows (the last of
    each stream and event). False, and nothing done, where the batch is committed already.

    Filtered rows and evidence are written once, to a folder that goes after the commit, and all tables come from there. State and aliases are
    read by the buckets that the batch's objects fall into.
    """
    store = Store(spark, root)
    last = store.last_batch()
    if last is not None and number <= last:
        return False
    staged = f"{root}/_staged/{number}-{uuid4().hex}"

    def stage(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{staged}/{name}")
        return spark.read.schema(df.schema).parquet(f"{staged}/{name}")

    try:
        tables = ingest(rows, prior=lambda ids: store.touched("object_state", ids), aliases=lambda ids: store.touched("canonical_ids", ids), readd_versions=readd_versions, enrich=True, stage=stage)
        tables["latest_raw"] = tables.pop("latest_raw_updates")
        return store.commit(number, tables | {"ingestion_offsets": coalesced_offsets(offsets)})
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def list_then_watch(spark: SparkSession, root: str, streams: DataFrame, listed: DataFrame, events: str, at: datetime, previous: DataFrame | None = None, namespace: str = "", files_per_trigger: int = 100) -> None:
    """Ingests a list, then all watch events (JSON lines of WATCHED below a folder, value as it came) that are there. Bookmarks store no
    observation. A second call takes what has come since; its list is skipped."""
    checkpoint = f"{root}/_watch"
    if not _exists(spark, f"{checkpoint}/offsets"):
        rows, offsets = list_once(streams, listed, empty(spark, "observations").select(*listed.columns) if previous is None else previous, at, namespace)
        ingest_batch(spark, root, 0, rows, offsets)

    def take(batch: DataFrame, number: int) -> None:
        stored, marks = split_bookmarks(decode(batch))
        seen, moved = observations(stored), observations(marks)
        ingest_batch(spark, root, number + 1, seen, offset_rows(seen, "watch", namespace).unionByName(offset_rows(moved, "bookmark", namespace)))

    stream = watch(spark, events, WATCHED, files_per_trigger)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

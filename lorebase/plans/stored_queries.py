"""Registered queries that go through stored tables: commits of several batches, keyed state, merged tables, reads by month."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import blobs, filters, sqlsurface, versions
from ..operators.graph import Adjacency, search_edges
from ..operators.quantiles import nearest_rank
from ..operators.trigrams import TextIndex
from ..sources.shared import new_folder
from ..sources.store import Store
from ..streaming.rollup import hourly_store, rollup_stream
from . import adapter, recipe_sql
from .ingest import raw_updates
from .queries import _V1, _V2, _query

_CUTS = ["2024-01-08", "2024-01-15", "2024-01-22"]
_VERSIONS = "object_id string, observed_at timestamp_ntz, seq bigint, doc_hash string"


def _batches(df: DataFrame, when: str) -> list[DataFrame]:
    """The rows of four stretches of time, as batches would bring them."""
    at = [F.lit(c).cast("timestamp_ntz") for c in _CUTS]
    t = F.col(when)
    return [df.where(t < at[0]), df.where((t >= at[0]) & (t < at[1])), df.where((t >= at[1]) & (t < at[2])), df.where(t >= at[2])]


@_query(_V2 + " SELECT object_id, observed_at, CAST(seq AS BIGINT) AS seq, doc_hash FROM s WHERE content_changed", "obs")
def k2_committed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, V3: versions made in four batches, each a commit of versions and state; a batch goes on from the state buckets of its own objects. The third is sent twice."""
    store = Store(spark, new_folder(spark, "versions"), schemas={"batch_versions": _VERSIONS})
    batches = _batches(adapter.observations(spark, sf_dir), "observed_at")
    for number, rows in [*enumerate(batches[:3]), (2, batches[2]), (3, batches[3])]:
        prior = store.touched("object_state", rows.select(*versions.OBJECT).distinct())
        marked = versions.changed(rows, True, prior=prior)
        store.commit(number, {"batch_versions": marked.where("content_changed"), "object_state": versions.prior_state(marked)})
    return store.read("batch_versions")


@_query("SELECT object_id, arg_max(doc, observed_at) AS doc FROM obs GROUP BY object_id HAVING arg_max(observation_type, observed_at) <> 'DELETED'", "obs")
def v8_raw_latest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest document of each live object as a table that four batches were merged into: updates, deletions, objects that come again."""
    store = Store(spark, new_folder(spark, "raw"))
    rows = adapter.observations(spark, sf_dir).withColumns({"raw": F.col("doc"), "outcome": F.lit(filters.KEEP)})
    for number, batch in enumerate(_batches(rows, "observed_at")):
        store.commit(number, {"latest_raw": raw_updates(batch)})
    return store.read("latest_raw").select("object_id", "doc")


@_query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS decisions, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1, 2")
def f15_rollup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of decisions as a table that batches of every third event were added to."""
    store = Store(spark, new_folder(spark, "rollup"))
    e = adapter.table(spark, sf_dir, "events")
    d = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("c1").alias("cluster_id"), F.col("event_type").alias("filter_name"), F.lit("keep_modified").alias("outcome"), F.lit("").alias("reason"))
    for number in range(3):
        store.commit(number, {"filter_rollup": filters.hourly_rollup(d.where(F.col("event_id") % 3 == number))})
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("hour", "first_at", "last_at")]
    return store.read("filter_rollup").select(times[0], F.col("filter_name").alias("event_type"), "decisions", *times[1:])


@_query("SELECT 'order/' || o_orderkey AS object_id, o_orderdate AS ts, o_orderstatus AS fact_value FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-10' AND o_orderdate <= TIMESTAMP '1995-06-20'")
def k6_month_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a time range out of a table by month, whose other months aren't read."""
    store = Store(spark, new_folder(spark, "facts"))
    o = adapter.table(spark, sf_dir, "orders")
    facts = o.select(
        F.lit("c1").alias("cluster_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("object_id"), F.lit("Order").alias("kind"), F.lit("").alias("namespace"),
        F.col("o_orderkey").cast("string").alias("name"), F.lit("order.status").alias("fact_key"), F.col("o_orderstatus").alias("fact_value"), F.col("o_totalprice").cast("double").alias("numeric_value"), F.lit(20).alias("severity"), F.lit("").alias("detail"),
    )
    store.commit(0, {"facts": facts})
    found = store.read("facts", datetime(1995, 3, 10), datetime(1995, 6, 20))
    return found.select("object_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "fact_value")


@_query("""+ a AS (SELECT object_id, unnest(list_distinct([object_id, 'c1/users/' || name])) AS alias_id, observed_at FROM obs) SELECT alias_id, arg_max(object_id, (observed_at, object_id)) AS canonical_id FROM a GROUP BY alias_id""", "obs")
def v5_canonical_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: the canonical id of each alias, as a table that batches were merged into."""
    from .ingest import canonical_ids

    store = Store(spark, new_folder(spark, "aliases"))
    rows = adapter.observations(spark, sf_dir).drop("object_id").withColumn("object_id", identity.logical_id())
    for number, batch in enumerate(_batches(rows, "observed_at")):
        store.commit(number, {"canonical_ids": canonical_ids(versions.alias_rows(batch))})
    return store.read("canonical_ids").select("alias_id", F.col("object_id").alias("canonical_id"))


@_query("SELECT event_type, q AS quantile, count(value) AS n, CASE q WHEN 0.5 THEN quantile_disc(value, 0.5) WHEN 0.95 THEN quantile_disc(value, 0.95) ELSE quantile_disc(value, 0.999) END AS value FROM events, (SELECT unnest([0.5, 0.95, 0.999]::DOUBLE[]) AS q) GROUP BY event_type, q")
def nearest_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles by histograms of ranges that narrow down."""
    return nearest_rank(adapter.table(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.95, 0.999])


@_query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'under the')")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold all terms, through an index of trigrams."""
    docs = adapter.table(spark, sf_dir, "documents")
    index = TextIndex.build(docs, ("doc_id",), F.col("text"), new_folder(spark, "trigrams"))
    return index.search(docs, F.col("text"), ["license", "Under the"]).select("doc_id", "n_chars")


def _round(number: int, limit: int) -> str:
    """A round of the search: the newest edges at what the rounds before have reached."""
    before = "(SELECT 'order/1' AS id)" if number == 1 else f"(SELECT src_id AS id FROM f{number - 1} UNION SELECT dst_id FROM f{number - 1} UNION SELECT 'order/1')"
    taken = f"SELECT * FROM r{number}" if number == 1 else f"SELECT * FROM f{number - 1} UNION SELECT * FROM r{number}"
    return f"""r{number} AS (SELECT DISTINCT * FROM edges WHERE src_id IN {before} OR dst_id IN {before} ORDER BY valid_from DESC, edge_type, src_id, dst_id LIMIT {limit}), f{number} AS ({taken})"""


@_query("+ " + ", ".join(_round(i, 200) for i in (1, 2, 3)) + " SELECT edge_type, src_id, dst_id, valid_from, valid_to FROM f3", "edges")
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of 200 edges around an order, over the adjacency layout."""
    count = lambda t: adapter.table(spark, sf_dir, t).count()  # noqa: E731  of the files' footers; counting the edges would join them
    rows = 2 * count("lineitem") + count("orders") + count("customer") + count("nation")
    graph = Adjacency.build(adapter.edges(spark, sf_dir), new_folder(spark, "adjacency"), rows=rows)
    return search_edges(graph, ["order/1"], limit=200, rounds=3).select("edge_type", "src_id", "dst_id", "valid_from", "valid_to")


@_query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS decisions, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1, 2")
def x9_stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events as a stream of decisions; the delay is longer than the table's time, so that the order of its files doesn't matter."""
    folder, path = new_folder(spark, "stream"), f"{sf_dir}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may name one file, a path only a folder
    d = e.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("c1").alias("cluster_id"), F.col("event_type").alias("filter_name"), F.lit("keep_modified").alias("outcome"), F.lit("").alias("reason"))
    rollup_stream(d, f"{folder}/tables", f"{folder}/checkpoint", "400 days")
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("hour", "first_at", "last_at")]
    return hourly_store(spark, f"{folder}/tables").read("hourly_counts").select(times[0], F.col("filter_name").alias("event_type"), "decisions", *times[1:])


@_query(_V1 + """, v AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY observed_at DESC, seq DESC) AS i FROM s WHERE content_changed)
SELECT doc_hash, CAST(any_value(strlen(doc)) AS BIGINT) AS size, CAST(count(*) FILTER (WHERE NOT (observed_at < TIMESTAMP '2024-01-28' AND i > 2)) AS BIGINT) AS references FROM v GROUP BY doc_hash""", "obs")
def m1_blob_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: documents stored once, and how many versions refer to each after retention; those without a reference can go."""
    v, stored = blobs.split_documents(versions.versions(versions.changed(adapter.observations(spark, sf_dir))))
    gone = blobs.policy_victims(v, datetime(2024, 1, 30), [blobs.Policy("old users", timedelta(days=2), 2, resources=("users",))])
    left = v.join(gone.select(*versions.OBJECT, "seq"), [*versions.OBJECT, "seq"], "left_anti")
    return blobs.references(stored, left)


def _recipes(spark: SparkSession, sf_dir: str) -> None:
    """The driver's tables as views, and the recipes over them."""
    at = lambda df, *cols: df.withColumns({c: F.col(c).cast("timestamp") for c in cols})
    o = at(adapter.observations(spark, sf_dir), "observed_at")
    views = {"observations": o, "versions": versions.versions(versions.changed(o)), "facts": at(adapter.facts(spark, sf_dir), "ts"), "changes": at(adapter.changes(spark, sf_dir), "ts")}
    sqlsurface.register_views(views)
    recipe_sql.install(spark)


@_query("SELECT fact_key, fact_value, count(*) AS rows, count(DISTINCT object_id) AS objects, max(severity) AS max_severity, max(ts) AS last_ts FROM facts WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY fact_key, fact_value", "facts")
def q5_fact_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe called in SQL with a named parameter."""
    _recipes(spark, sf_dir)
    return spark.sql("SELECT fact_key, fact_value, rows, objects, max_severity, CAST(last_ts AS TIMESTAMP_NTZ) AS last_ts FROM recipe_fact_rollup(starting => TIMESTAMP '2024-01-10')")


@_query("""+ b AS (SELECT uid FROM obs WHERE observed_at < TIMESTAMP '2024-01-15' GROUP BY uid HAVING arg_max(observation_type, observed_at) <> 'DELETED'),
i AS (SELECT uid, min(observed_at) FILTER (WHERE observation_type <> 'DELETED') AS fp, min(observed_at) FILTER (WHERE observation_type = 'DELETED') AS fd, count(*) AS n FROM obs WHERE observed_at >= TIMESTAMP '2024-01-15' AND observed_at < TIMESTAMP '2024-01-20' GROUP BY uid)
SELECT uid, 1 AS from_baseline, TIMESTAMP '2024-01-15' AS interval_start, fd AS interval_end, coalesce(n, 0) AS observation_rows FROM b LEFT JOIN i USING (uid)
UNION ALL SELECT uid, 0, fp, fd, n FROM i WHERE fp IS NOT NULL AND uid NOT IN (SELECT uid FROM b)""", "obs")
def q5_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of presence by a recipe called in SQL."""
    _recipes(spark, sf_dir)
    times = "CAST(interval_start AS TIMESTAMP_NTZ) AS interval_start, CAST(interval_end AS TIMESTAMP_NTZ) AS interval_end"
    return spark.sql(f"SELECT uid, from_baseline, {times}, observation_rows FROM recipe_presence_intervals('User', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-20')")

"""Schemas of the evidence tables. Strings are never null ('' means absent); only the columns named nullable are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

REF = "api_group string, api_version string, resource string, kind string, namespace string, name string, uid string"
OBJECT = "object_id string, kind string, namespace string, name string"

TABLES: dict[str, str] = {
    "clusters": "name string, uid string, source string, created_at timestamp",
    "api_resources": "api_group string, api_version string, resource string, kind string, namespaced boolean, verbs string, last_discovered_at timestamp",
    "observations": f"cluster_id string, observed_at timestamp, observation_type string, {REF}, resource_version string, partial boolean, doc_hash string, doc string",
    "object_aliases": "cluster_id string, object_id string, alias_id string, kind string, namespace string, name string, observed_at timestamp",
    "versions": f"cluster_id string, object_id string, seq bigint, observed_at timestamp, {REF}, resource_version string, doc_hash string, materialization string, blob_ref string, raw_size bigint, stored_size bigint, doc string",
    "facts": f"cluster_id string, ts timestamp, {OBJECT}, fact_key string, fact_value string, numeric_value double, severity int, detail string",
    "edges": "cluster_id string, edge_type string, src_id string, dst_id string, src_kind string, dst_kind string, valid_from timestamp, valid_to timestamp, detail string",
    "changes": f"cluster_id string, ts timestamp, {OBJECT}, change_family string, path string, op string, old_scalar string, new_scalar string, severity int",
    "filter_decisions": f"ts timestamp, cluster_id string, {REF}, resource_version string, observation_type string, filter_name string, outcome string, reason string, destructive boolean, meta string",
    "ingestion_offsets": "cluster_id string, api_group string, api_version string, resource string, kind string, namespaced boolean, namespace string, resource_version string, event string, status string, error string, last_list_at timestamp, last_watch_at timestamp, last_bookmark_at timestamp, updated_at timestamp",
    "agent_sessions": "session_id string, title string, created_at timestamp, updated_at timestamp",
    "agent_runs": "run_id string, session_id string, status string, input string, answer string, started_at timestamp, updated_at timestamp",
    "agent_run_events": "run_id string, seq bigint, event string, payload string, ts timestamp",
}
#: Month partition column of each append table.
PARTITIONED = {"observations": "observed_at", "versions": "observed_at", "facts": "ts", "edges": "valid_from", "changes": "ts", "filter_decisions": "ts"}

Tables = dict[str, DataFrame]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def schema_drift(df: DataFrame, table: str) -> list[str]:
    """What differs between a table's columns and the expected ones (M6)."""
    want = {f.name: f.dataType for f in StructType.fromDDL(TABLES[table])}
    have = {f.name: f.dataType for f in df.schema}
    return [f"missing {c}" for c in want if c not in have] + [f"extra {c}" for c in have if c not in want] + [f"type of {c}: {have[c].simpleString()}" for c in want if c in have and have[c] != want[c]]

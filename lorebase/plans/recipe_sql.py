"""Recipes as table functions of SQL (Q5): each can be called in a read-only statement, with its parameters by name or place.

install() makes them temporary functions of the session, over the views that sqlsurface.register_views() makes of the evidence tables. Times are
inclusive at the start and exclusive at the end; the defaults take everything.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_SPAN = "starting TIMESTAMP DEFAULT TIMESTAMP '1900-01-01', ending TIMESTAMP DEFAULT TIMESTAMP '9999-01-01'"
_CLUSTER = "cluster STRING DEFAULT ''"


def _in_cluster(alias: str = "") -> str:
    return f"(cluster = '' OR {alias}cluster_id = cluster)"


def _newest_docs(kind: str) -> str:
    """The newest document of each live object of a kind."""
    return f"""SELECT * FROM (SELECT cluster_id, namespace, name, uid, max_by(doc, struct(observed_at, observation_type)) AS doc, max_by(observation_type, struct(observed_at, observation_type)) AS last_type, max(observed_at) AS last_seen
FROM observations WHERE kind = {kind} AND observed_at >= starting AND observed_at < ending AND {_in_cluster()} GROUP BY cluster_id, namespace, name, uid) WHERE last_type <> 'DELETED'"""


_CONTAINERS = "array<struct<name:string,image:string,resources:struct<requests:map<string,string>,limits:map<string,string>>>>"

#: name: (parameters, columns, query)
RECIPES: dict[str, tuple[str, str, str]] = {
    "recipe_coverage_latest": (
        f"{_CLUSTER}, {_SPAN}", "cluster_id STRING, kind STRING, objects BIGINT, last_seen TIMESTAMP",
        f"""WITH o AS (SELECT cluster_id, kind, max_by(observation_type, struct(observed_at, observation_type)) AS t, max(observed_at) AS seen FROM observations
WHERE observed_at >= starting AND observed_at < ending AND {_in_cluster()} GROUP BY cluster_id, kind, namespace, name, uid)
SELECT cluster_id, kind, count(*), max(seen) FROM o WHERE t <> 'DELETED' GROUP BY cluster_id, kind""",
    ),
    "recipe_fact_rollup": (
        f"{_CLUSTER}, {_SPAN}", "fact_key STRING, fact_value STRING, rows BIGINT, objects BIGINT, max_severity INT, last_ts TIMESTAMP",
        f"SELECT fact_key, fact_value, count(*), count(DISTINCT object_id), max(severity), max(ts) FROM facts WHERE ts >= starting AND ts < ending AND {_in_cluster()} GROUP BY fact_key, fact_value",
    ),
    "recipe_change_rollup": (
        f"{_CLUSTER}, {_SPAN}", "change_family STRING, path STRING, rows BIGINT, objects BIGINT, last_ts TIMESTAMP",
        f"SELECT change_family, path, count(*), count(DISTINCT object_id), max(ts) FROM changes WHERE ts >= starting AND ts < ending AND {_in_cluster()} GROUP BY change_family, path",
    ),
    "recipe_container_rows": (
        f"{_CLUSTER}, {_SPAN}", "cluster_id STRING, namespace STRING, name STRING, uid STRING, container STRING, image STRING, cpu_request STRING, memory_request STRING, cpu_limit STRING, memory_limit STRING, last_seen TIMESTAMP",
        f"""SELECT p.cluster_id, p.namespace, p.name, p.uid, c.name, c.image, try_element_at(c.resources.requests, 'cpu'), try_element_at(c.resources.requests, 'memory'), try_element_at(c.resources.limits, 'cpu'), try_element_at(c.resources.limits, 'memory'), p.last_seen
FROM ({_newest_docs("'Pod'")}) AS p LATERAL VIEW explode(from_json(get_json_object(p.doc, '$.spec.containers'), '{_CONTAINERS}')) AS c""",
    ),
    "recipe_allocation_rollup": (
        f"{_CLUSTER}, {_SPAN}", "cluster_id STRING, namespace STRING, pods BIGINT, containers BIGINT, without_requests BIGINT, last_seen TIMESTAMP",
        f"""SELECT p.cluster_id, p.namespace, count(DISTINCT p.name), count(*), count_if(try_element_at(c.resources.requests, 'cpu') IS NULL AND try_element_at(c.resources.requests, 'memory') IS NULL), max(p.last_seen)
FROM ({_newest_docs("'Pod'")}) AS p LATERAL VIEW explode(from_json(get_json_object(p.doc, '$.spec.containers'), '{_CONTAINERS}')) AS c GROUP BY p.cluster_id, p.namespace""",
    ),
    "recipe_namespace_delta": (
        "starting TIMESTAMP, ending TIMESTAMP", "cluster_id STRING, namespace STRING, kind STRING, at_start BIGINT, at_end BIGINT, difference BIGINT",
        """WITH o AS (SELECT *, observed_at < starting AS early FROM observations WHERE observed_at < ending),
g AS (SELECT cluster_id, namespace, kind, max_by(observation_type, struct(observed_at, observation_type)) FILTER (WHERE early) AS a, max_by(observation_type, struct(observed_at, observation_type)) AS b FROM o GROUP BY cluster_id, namespace, kind, name, uid)
SELECT cluster_id, namespace, kind, count_if(a <> 'DELETED'), count_if(b <> 'DELETED'), count_if(b <> 'DELETED') - count_if(a <> 'DELETED') FROM g GROUP BY cluster_id, namespace, kind""",
    ),
    "recipe_presence_intervals": (
        "wanted_kind STRING, starting TIMESTAMP, ending TIMESTAMP", "cluster_id STRING, namespace STRING, name STRING, uid STRING, from_baseline INT, interval_start TIMESTAMP, interval_end TIMESTAMP, observation_rows BIGINT",
        """WITH o AS (SELECT *, observed_at < starting AS early FROM observations WHERE kind = wanted_kind AND observation_type IN ('ADDED', 'MODIFIED', 'DELETED') AND observed_at < ending),
g AS (SELECT cluster_id, namespace, name, uid, max_by(observation_type, struct(observed_at, observation_type)) FILTER (WHERE early) AS before,
  min(observed_at) FILTER (WHERE NOT early AND observation_type <> 'DELETED') AS first_at, min(observed_at) FILTER (WHERE NOT early AND observation_type = 'DELETED') AS gone_at,
  count_if(NOT early) AS n FROM o GROUP BY cluster_id, namespace, name, uid)
SELECT cluster_id, namespace, name, uid, CASE WHEN coalesce(before, 'DELETED') <> 'DELETED' THEN 1 ELSE 0 END, CASE WHEN coalesce(before, 'DELETED') <> 'DELETED' THEN starting ELSE first_at END, gone_at, n
FROM g WHERE coalesce(before, 'DELETED') <> 'DELETED' OR first_at IS NOT NULL""",
    ),
    "recipe_endpointslices": (
        f"{_CLUSTER}, {_SPAN}", "cluster_id STRING, namespace STRING, service STRING, slices BIGINT, endpoints BIGINT, ready BIGINT",
        f"""SELECT cluster_id, namespace, service, count(DISTINCT name), count(e), count_if(e.conditions.ready) FROM (SELECT cluster_id, namespace, name, coalesce(get_json_object(doc, "$.metadata.labels['kubernetes.io/service-name']"), '') AS service,
  explode_outer(from_json(get_json_object(doc, '$.endpoints'), 'array<struct<conditions:struct<ready:boolean>>>')) AS e FROM ({_newest_docs("'EndpointSlice'")})) GROUP BY cluster_id, namespace, service""",
    ),
    "recipe_node_capacity": (
        f"{_CLUSTER}, {_SPAN}", "cluster_id STRING, name STRING, instance_type STRING, cpu STRING, memory STRING, pods STRING, last_seen TIMESTAMP",
        f"""SELECT cluster_id, name, coalesce(get_json_object(doc, "$.metadata.labels['node.kubernetes.io/instance-type']"), 'unknown'), get_json_object(doc, '$.status.capacity.cpu'), get_json_object(doc, '$.status.capacity.memory'), get_json_object(doc, '$.status.capacity.pods'), last_seen
FROM ({_newest_docs("'Node'")})""",
    ),
    "recipe_lifecycle": (
        f"wanted_kind STRING, {_SPAN}", "cluster_id STRING, observation_type STRING, namespace STRING, name STRING, uid STRING, first_seen TIMESTAMP, last_seen TIMESTAMP",
        "SELECT cluster_id, observation_type, namespace, name, uid, min(observed_at), max(observed_at) FROM observations WHERE kind = wanted_kind AND observation_type IN ('ADDED', 'DELETED') AND observed_at >= starting AND observed_at < ending GROUP BY cluster_id, observation_type, namespace, name, uid",
    ),
    "recipe_value_changes": (
        f"path_like STRING, {_SPAN}", "cluster_id STRING, object_id STRING, path STRING, `values` ARRAY<STRING>, first_ts TIMESTAMP, last_ts TIMESTAMP",
        "SELECT * FROM (SELECT cluster_id, object_id, path, array_sort(collect_set(new_scalar)) AS found, min(ts), max(ts) FROM changes WHERE path LIKE path_like AND ts >= starting AND ts < ending GROUP BY cluster_id, object_id, path) WHERE size(found) > 1",
    ),
    "recipe_value_history": (
        f"path_like STRING, {_SPAN}", "cluster_id STRING, object_id STRING, path STRING, ts TIMESTAMP, value STRING",
        """SELECT cluster_id, object_id, path, ts, new_scalar FROM (SELECT *, lag(new_scalar) OVER (PARTITION BY cluster_id, object_id, path ORDER BY ts, new_scalar) AS before FROM changes WHERE path LIKE path_like AND ts >= starting AND ts < ending)
WHERE before IS NULL OR before <> new_scalar""",
    ),
    "recipe_doc_fields": (
        "wanted_kind STRING DEFAULT ''", "kind STRING, field STRING, rows BIGINT",
        "SELECT kind, field, count(*) FROM versions LATERAL VIEW explode(json_object_keys(doc)) AS field WHERE wanted_kind = '' OR kind = wanted_kind GROUP BY kind, field",
    ),
    "recipe_object_proof": (
        "wanted STRING, most INT DEFAULT 5", "object_id STRING, seq BIGINT, observed_at TIMESTAMP, doc_hash STRING, doc STRING",
        "SELECT object_id, seq, observed_at, doc_hash, doc FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY seq DESC) AS place FROM versions WHERE object_id = wanted) WHERE place <= most",
    ),
}


def install(spark: SparkSession) -> list[str]:
    """Makes the recipes callable in this session; the views must be there."""
    for name, (parameters, columns, query) in RECIPES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
    return list(RECIPES)

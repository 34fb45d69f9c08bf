"""Registered queries of reads, recipes and upkeep over the driver's tables as evidence, each with SQL for the same rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, maintain, read, versions
from ..sources.shared import dealt, new_folder
from . import adapter, recipes
from .queries import _V1, _V2, ORACLE_SQL, _marked, _query


def _text(c: str) -> Column:
    return F.col(c).cast("string")


@_query(_V1 + """, v AS (SELECT * FROM s WHERE content_changed)
SELECT count(*) AS versions, count(DISTINCT object_id) AS objects, count(DISTINCT doc_hash) AS distinct_documents, CAST(sum(strlen(doc)) AS BIGINT) AS raw_bytes, CAST(sum(strlen(doc)) AS BIGINT) AS stored_bytes, 1.0::DOUBLE AS ratio,
  (SELECT count(*) FROM obs) AS observations, (SELECT count(*) FROM facts) AS facts, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM changes) AS changes FROM v""", "obs", "facts", "changes", "edges")
def r27_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R27, P10."""
    return read.stats(adapter.tables(spark, sf_dir) | {"versions": versions.versions(_marked(spark, sf_dir, False))})


@_query("SELECT 'c1' AS cluster_id, event_type AS filter_name, 'keep_modified' AS outcome, '' AS reason, count(*) AS decisions FROM events GROUP BY event_type")
def r29_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions kept in detail and counted by the hour, together."""
    e = adapter.table(spark, sf_dir, "events")
    d = e.select("value", "ts", F.lit("c1").alias("cluster_id"), F.col("event_type").alias("filter_name"), F.lit("keep_modified").alias("outcome"), F.lit("").alias("reason"))
    return read.decision_counts(d.where("value > 50"), filters.hourly_rollup(d.where("value <= 50 OR value IS NULL")))


_FOUND = "contains(lower({0}), 'click') AND contains(lower({0}), '1')"


@_query(f"""+ v AS (SELECT object_id, arg_max(doc, observed_at) AS doc, max(observed_at) AS ts FROM obs GROUP BY object_id),
f AS (SELECT object_id, ts, 20 + severity AS score, 'fact:' || fact_key AS reason FROM facts WHERE {_FOUND.format("fact_key || chr(10) || fact_value || chr(10)")} ORDER BY ts DESC, object_id LIMIT 400),
c AS (SELECT object_id, ts, 15 + severity AS score, 'change:' || path AS reason FROM changes WHERE {_FOUND.format("concat_ws(chr(10), change_family, path, old_scalar, new_scalar)")} ORDER BY ts DESC, object_id LIMIT 400),
d AS (SELECT object_id, ts, 10, 'document' FROM v WHERE {_FOUND.format("doc")}),
h AS (SELECT * FROM f UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d)
SELECT object_id, CAST(sum(score) AS BIGINT) AS score, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons, max(ts) AS latest FROM h GROUP BY object_id ORDER BY score DESC, object_id LIMIT 20""", "obs", "facts", "changes")
def r13_search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search with its cap of rows and the newest documents."""
    o = adapter.observations(spark, sf_dir).withColumn("seq", F.lit(0))
    found = read.search(adapter.tables(spark, sf_dir) | {"versions": o}, "click 1", limit=20, documents=True)
    return found.select("object_id", "score", F.array_join("reasons", ",").alias("reasons"), "latest")


@_query(ORACLE_SQL["search_score"])
def r12_indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of search_score, through trigram indexes of facts and changes."""
    t = adapter.tables(spark, sf_dir)
    indexes = read.search_indexes(t, new_folder(spark, "search"))
    return read.search(t, "error 1", limit=20, cap_rows=False, indexes=indexes).select("object_id", "score", "latest")


@_query("""SELECT r AS resource, bool_or(d) AS discovered, CAST(sum(n) AS BIGINT) AS observations FROM (SELECT p_brand AS r, true AS d, 0 AS n FROM part WHERE p_size > 25 UNION ALL SELECT p_brand, false, count(*) FROM part WHERE p_size <= 40 GROUP BY p_brand) GROUP BY r""")
def r32_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as resources: discovered by large parts, ingested by small ones."""
    p = adapter.table(spark, sf_dir, "part").select("p_size", F.lit("").alias("api_group"), F.col("p_brand").alias("resource"))
    return read.coverage({"api_resources": p.where("p_size > 25"), "observations": p.where("p_size <= 40")}).drop("api_group")


@_query("SELECT c_mktsegment AS session_id, count(*) AS runs, arg_max('run-' || c_custkey, (c_acctbal, 'run-' || c_custkey)) AS last_run FROM customer GROUP BY c_mktsegment")
def r30_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as sessions, customers as their runs."""
    c = adapter.table(spark, sf_dir, "customer")
    runs = c.select(F.concat(F.lit("run-"), _text("c_custkey")).alias("run_id"), F.col("c_mktsegment").alias("session_id"), F.lit("done").alias("status"), F.lit("").alias("answer"), F.col("c_acctbal").alias("updated_at"))
    made = c.groupBy(F.col("c_mktsegment").alias("session_id")).agg(F.max("c_acctbal").alias("updated_at"))
    return read.sessions({"agent_runs": runs, "agent_sessions": made}).select("session_id", "runs", "last_run")


@_query(_V1 + """, v AS (SELECT * FROM s WHERE content_changed)
SELECT v.object_id, CAST(seq AS BIGINT) AS seq FROM v WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.object_id = v.object_id AND f.ts = v.observed_at AND starts_with(f.fact_key, 'event.c'))""", "obs", "facts")
def v14_without_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of users that a kind of fact is missing of."""
    v = versions.versions(_marked(spark, sf_dir, False))
    return versions.without_facts(v, adapter.facts(spark, sf_dir), "event.c", "User").select("object_id", "seq")


@_query(_V1 + """, v AS (SELECT * FROM s WHERE content_changed)
SELECT v.object_id, CAST(v.seq AS BIGINT) AS seq, arg_min(o.observation_type, (o.observed_at, o.observation_type)) AS observation_type FROM v JOIN obs o ON o.object_id = v.object_id AND o.doc_hash = v.doc_hash GROUP BY v.object_id, v.seq""", "obs")
def v13_reindex_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions as observations again, with the type of their document's first sighting."""
    o = adapter.observations(spark, sf_dir)
    v = versions.versions(versions.changed(o))
    return versions.reindex_input(v, o).select("object_id", "seq", "observation_type")


@_query("""SELECT 'users-' || event_type AS resource, arg_max(CAST(event_id AS VARCHAR), (ts, 'watch')) AS resource_version, max(ts) AS updated_at, max(ts) FILTER (WHERE value > 50) AS last_list_at, max(ts) FILTER (WHERE value <= 50) AS last_watch_at FROM events GROUP BY event_type""")
def v16_merged_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a stream, of events as offset rows."""
    e = adapter.table(spark, sf_dir, "events")
    large = F.col("value") > 50
    empty = {c: F.lit("") for c in ("api_group", "namespace", "api_version", "kind", "error")}
    o = e.select(F.lit("c1").alias("cluster_id"), F.concat(F.lit("users-"), "event_type").alias("resource"), _text("event_id").alias("resource_version"), F.lit("watch").alias("event"), F.lit("ok").alias("status"), F.lit(True).alias("namespaced"), F.when(large, F.col("ts")).alias("last_list_at"), F.when(F.col("value") <= 50, F.col("ts")).alias("last_watch_at"), F.lit(None).cast("timestamp_ntz").alias("last_bookmark_at"), F.col("ts").alias("updated_at"))
    return versions.merged_offsets(o.withColumns(empty)).select("resource", "resource_version", "updated_at", "last_list_at", "last_watch_at")


@_query("""SELECT c_nationkey, arg_max(c_name, c_custkey) AS c_name, arg_max(c_comment, c_custkey) FILTER (WHERE c_comment <> '') AS c_comment FROM (SELECT c_nationkey, c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS c_comment FROM customer) GROUP BY c_nationkey""")
def v18_latest_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key, where an empty value doesn't replace a known one."""
    c = adapter.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("c_comment"))
    return versions.latest_by(c, ["c_nationkey"], "c_custkey", keep_known=("c_comment",)).select("c_nationkey", "c_name", "c_comment")


@_query("SELECT k AS field, count(*) AS rows FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def t13_doc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13."""
    return recipes.doc_fields(adapter.observations(spark, sf_dir)).select("field", "rows")


@_query("""SELECT 'order/' || l_orderkey AS service_id, count(DISTINCT l_partkey) AS slices, count(DISTINCT ps) AS pods FROM lineitem LEFT JOIN (SELECT DISTINCT l_partkey AS pk, l_suppkey AS ps FROM lineitem WHERE l_linenumber = 1) ON pk = l_partkey GROUP BY l_orderkey""")
def t27_service_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as services, parts as their slices, suppliers of first lines as pods of a part."""
    lines = adapter.table(spark, sf_dir, "lineitem")
    ident = lambda kind, c: F.concat(F.lit(f"{kind}/"), _text(c))
    s = lines.select(F.lit("c1").alias("cluster_id"), F.lit("endpointslice_for_service").alias("edge_type"), ident("part", "l_partkey").alias("src_id"), ident("order", "l_orderkey").alias("dst_id"))
    p = lines.where("l_linenumber = 1").select(F.lit("c1").alias("cluster_id"), F.lit("endpointslice_targets_pod").alias("edge_type"), ident("part", "l_partkey").alias("src_id"), ident("supplier", "l_suppkey").alias("dst_id"))
    return recipes.service_topology_counts(s.unionByName(p), lines.count()).drop("cluster_id")


def _pod_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pods in namespaces by status, their lines as containers; every fifth line has no requests."""
    lines = adapter.table(spark, sf_dir, "lineitem")
    requests = F.when(F.col("l_linenumber") % 5 != 0, F.struct(F.concat(_text("l_suppkey"), F.lit("m")).alias("cpu"), F.concat(_text("l_linenumber"), F.lit("Mi")).alias("memory")))
    container = F.struct(F.concat(F.lit("c"), _text("l_linenumber")).alias("name"), F.lit("i").alias("image"), F.struct(requests.alias("requests")).alias("resources"))
    rows = lines.count()
    pods = dealt(lines, rows, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(container).alias("containers")).join(dealt(adapter.table(spark, sf_dir, "orders"), rows, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    doc = F.to_json(F.struct(F.struct("containers").alias("spec")))
    docs = pods.select(F.lit("c1").alias("cluster_id"), F.col("o_orderdate").alias("observed_at"), F.lit("ADDED").alias("observation_type"), F.lit("Pod").alias("kind"), F.lower("o_orderstatus").alias("namespace"), F.concat(F.lit("o-"), _text("o_orderkey")).alias("name"), _text("o_orderkey").alias("uid"), doc.alias("doc"))
    return dealt(docs, rows, "uid")


@_query("""SELECT lower(o_orderstatus) AS namespace, count(*) AS containers, count(*) FILTER (WHERE l_linenumber % 5 = 0) AS without_requests, CAST(round(sum(CASE WHEN l_linenumber % 5 <> 0 THEN l_suppkey END)) AS BIGINT) AS millicores,
  CAST(sum(CASE WHEN l_linenumber % 5 <> 0 THEN l_linenumber * 1048576 END) AS BIGINT) AS memory FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus""")
def t4_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and their requests by namespace, read from the pods' documents."""
    a = recipes.allocation_rollup(_pod_docs(spark, sf_dir))
    return a.select("namespace", "containers", "without_requests", F.round(F.col("cpu_requests") * 1000).cast("long").alias("millicores"), F.col("memory_requests").cast("long").alias("memory"))


@_query(_V2 + """, v AS (SELECT object_id, seq FROM s WHERE content_changed), seen AS (SELECT DISTINCT object_id, seq FROM s WHERE observed_at >= TIMESTAMP '2024-01-20')
SELECT v.object_id, CAST(v.seq AS BIGINT) AS seq FROM v JOIN seen USING (object_id, seq)""", "obs")
def m2_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: versions that a sighting since a day refers to."""
    m = _marked(spark, sf_dir)
    return maintain.prune_unreferenced(versions.versions(m), m.where("observed_at >= TIMESTAMP_NTZ '2024-01-20'")).select("object_id", "seq")


@_query("""SELECT o_orderkey AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders) WHERE i = 1 OR o_orderstatus = 'F' OR o_orderdate >= TIMESTAMP '1998-01-01'""")
def m7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: orders as runs of customers' sessions: old failed runs that a later one took over go."""
    o = adapter.table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("session_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return maintain.retain_runs({"agent_runs": runs, "agent_run_events": runs.select("run_id")}, datetime(1998, 1, 31), timedelta(days=30))["agent_runs"].select("run_id")


@_query("""+ w AS (SELECT DISTINCT object_id FROM facts WHERE severity >= 90), f AS (SELECT object_id, count(*) AS n FROM facts GROUP BY object_id), c AS (SELECT object_id, count(*) AS n FROM changes GROUP BY object_id),
v AS (SELECT object_id, count(*) AS n, arg_max(doc, observed_at) AS latest FROM obs GROUP BY object_id)
SELECT w.object_id, least(coalesce(f.n, 0), 1000) AS facts, least(coalesce(c.n, 0), 1000) AS changes, least(coalesce(v.n, 0), 3) AS versions, latest FROM w LEFT JOIN f USING (object_id) LEFT JOIN c USING (object_id) LEFT JOIN v USING (object_id)""", "obs", "facts", "changes")
def r14_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of all users with a severe fact: how much each part holds, and the newest document."""
    t = adapter.tables(spark, sf_dir)
    o = t["observations"].withColumn("seq", F.col("resource_version").cast("long"))
    wanted = t["facts"].where("severity >= 90").select("cluster_id", "object_id").distinct()
    b = read.bundles(t | {"versions": o, "edges": t["edges"].limit(0)}, wanted)
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long").alias(c)
    return b.select("object_id", *(F.when(F.col(c).isNull(), 0).otherwise(size(c)).alias(c) for c in ("facts", "changes", "versions")), "latest")


@_query("""SELECT 'c' || c_nationkey AS cluster_id, count(*) AS observations, count(*) FILTER (WHERE c_acctbal > 0) AS versions, count(*) FILTER (WHERE c_acctbal > 5000) AS facts, 0::BIGINT AS edges FROM customer WHERE c_nationkey <> 7 GROUP BY c_nationkey""")
def r25_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as clusters with the number of their rows in each table, one of them deleted."""
    c = adapter.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), _text("c_nationkey")).alias("cluster_id"), "c_acctbal")
    t = {"clusters": c.select(F.col("cluster_id").alias("name")).distinct(), "observations": c, "versions": c.where("c_acctbal > 0"), "facts": c.where("c_acctbal > 5000"), "edges": c.limit(0)}
    return read.list_clusters(read.without_cluster(t, "c7"))


@_query("""SELECT 'rbac_binding_binds_subject' AS edge_type, 'customer/' || c_custkey AS src_id, 'nation/' || c_nationkey AS dst_id, 'Binding' AS source_kind, c_name AS source_name, 'Group' AS target_kind, n_name AS target_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND n_regionkey <> 2""")
def t22_named_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as bindings, nations as subjects; customers in debt and one region's nations aren't known as objects."""
    t = lambda n: adapter.table(spark, sf_dir, n)
    named = lambda df, kind, key, name: df.select(F.lit("c1").alias("cluster_id"), F.concat(F.lit(f"{key.split('_')[1].removesuffix('key').replace('cust', 'customer')}/"), _text(key)).alias("object_id"), F.lit(kind).alias("kind"), F.lit("").alias("namespace"), F.col(name).alias("name"))
    objects = named(t("customer").where("c_acctbal > 0"), "Binding", "c_custkey", "c_name").unionByName(named(t("nation").where("n_regionkey <> 2"), "Group", "n_nationkey", "n_name"))
    edges = adapter.edges(spark, sf_dir).withColumn("edge_type", F.when(F.col("edge_type") == "customer_nation", "rbac_binding_binds_subject").otherwise(F.col("edge_type")))
    return recipes.rbac_chain(edges, objects).select("edge_type", "src_id", "dst_id", "source_kind", "source_name", "target_kind", "target_name")


@_query("SELECT fact_key, count(*) AS rows, count(DISTINCT object_id) AS objects, count(DISTINCT fact_value) AS values, max(severity) AS max_severity FROM facts GROUP BY fact_key", "facts")
def t26_fact_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T26."""
    return recipes.fact_inventory(adapter.facts(spark, sf_dir))


@_query(_V1 + """, v AS (SELECT * FROM s WHERE content_changed)
SELECT 'observations' AS "table", count(*) AS rows, max(observed_at) AS newest FROM obs UNION ALL SELECT 'versions', count(*), max(observed_at) FROM v UNION ALL SELECT 'facts', count(*), max(ts) FROM facts
UNION ALL SELECT 'edges', count(*), max(valid_from) FROM edges UNION ALL SELECT 'changes', count(*), max(ts) FROM changes""", "obs", "facts", "changes", "edges")
def t28_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T28."""
    t = adapter.tables(spark, sf_dir)
    return recipes.overview(versions=versions.versions(_marked(spark, sf_dir, False)), **t).drop("cluster_id")


@_query(_V1 + " SELECT kind, count(DISTINCT object_id) AS objects, count(*) AS versions, CAST(sum(strlen(doc)) AS BIGINT) AS bytes FROM s WHERE content_changed GROUP BY kind", "obs")
def t28_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T28."""
    return recipes.kind_distribution(versions.versions(_marked(spark, sf_dir, False))).drop("cluster_id")

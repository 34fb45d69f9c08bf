"""Backfill, metadata, cluster reads, maintenance and result formats on small tables."""

from datetime import datetime, timedelta

import pytest
from lorebase.operators import maintain, read, versions
from lorebase.schema import empty
from lorebase.sources import sinks

T0 = datetime(2024, 5, 1)
MIN = timedelta(minutes=1)


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_rehash_joins_equal_neighbours(spark):
    rows = [("c", "a", s, h, d) for s, h, d in [(1, "h1", '{"x":1}'), (2, "h2", '{"x":1}'), (3, "h3", '{"x":2}'), (4, "h4", '{"x":1}')]]
    v = versions.rehash(spark.createDataFrame(rows, "cluster_id string, object_id string, seq bigint, doc_hash string, doc string"))
    assert got(v, "seq", "doc") == [(1, '{"x":1}'), (2, '{"x":2}'), (3, '{"x":1}')]


def test_reindex_input(spark):
    v = spark.createDataFrame([("c", "a", "h1"), ("c", "a", "h2")], "cluster_id string, object_id string, doc_hash string")
    o = spark.createDataFrame([("c", "a", "h1", "DELETED", T0 + MIN), ("c", "a", "h1", "ADDED", T0)], "cluster_id string, object_id string, doc_hash string, observation_type string, observed_at timestamp")
    assert got(versions.reindex_input(v, o), "doc_hash", "observation_type") == [("h1", "ADDED"), ("h2", "MODIFIED")]


def test_versions_without_facts(spark):
    v = spark.createDataFrame([("c", "a", "Service", T0), ("c", "a", "Service", T0 + MIN), ("c", "b", "Pod", T0)], "cluster_id string, object_id string, kind string, observed_at timestamp")
    f = spark.createDataFrame([("c", "a", T0, "service.type"), ("c", "a", T0 + MIN, "other")], "cluster_id string, object_id string, ts timestamp, fact_key string")
    assert got(versions.without_facts(v, f), "object_id", "observed_at") == [("a", T0 + MIN)]


@pytest.mark.parametrize("keep,uid", [(("uid",), "u1"), ((), "")])
def test_newest_row_of_a_key(spark, keep, uid):
    df = spark.createDataFrame([("a", "u1", "file", 1), ("a", "", "live", 2)], "name string, uid string, source string, at int")
    assert got(versions.latest_by(df, ["name"], "at", keep), "name", "uid", "source") == [("a", uid, "live")]


def test_identities(spark):
    rows = [("", T0, "ADDED"), ("u1", T0 + MIN, "MODIFIED"), ("", T0 + 2 * MIN, "DELETED")]
    refs = spark.createDataFrame([("c", "", "pods", "s", "a", u, t, k) for u, t, k in rows] + [("c", "", "pods", "s", "b", "", T0, "ADDED")], "cluster_id string, api_group string, resource string, namespace string, name string, uid string, observed_at timestamp, observation_type string")
    assert got(versions.identity_matches(refs), "name", "uid", "first_seen", "deleted") == [("a", "u1", T0, True), ("b", "", T0, False)]


def test_clusters(spark):
    t = {n: empty(spark, n) for n in ("clusters", "observations", "versions", "facts", "edges")}
    t["clusters"] = spark.createDataFrame([("known", "", "", T0)], t["clusters"].schema)
    t["facts"] = spark.createDataFrame([("seen", T0, "a", "k", "", "n", "f", "v", None, 1, "")] * 2, t["facts"].schema)
    assert got(read.list_clusters(t), "cluster_id", "facts", "edges") == [("known", 0, 0), ("seen", 2, 0)]
    left = read.without_cluster(t, "seen")
    assert got(read.list_clusters(left), "cluster_id") == [("known",)]
    assert read.list_clusters(read.without_cluster(left, "known")).count() == 0


def test_integrity(spark):
    t = {n: empty(spark, n) for n in ("versions", "ingestion_offsets")}
    assert read.integrity(t, T0).first()["secret_payload_violations"] == 0
    t["versions"] = spark.createDataFrame([("secrets", '{"data":{}}'), ("secrets", '{"metadata":{}}'), ("configmaps", '{"data":{}}')], "resource string, doc string")
    t["ingestion_offsets"] = spark.createDataFrame([(T0 - 3 * MIN,), (T0 - MIN,)], "updated_at timestamp")
    assert got(read.integrity(t, T0), "max_lag_s", "secret_payload_violations") == [(180, 1)]


def test_decision_counts(spark):
    d = spark.createDataFrame([("c", "f", "keep", "r")] * 2, "cluster_id string, filter_name string, outcome string, reason string")
    r = spark.createDataFrame([("c", "f", "keep", "r", 5), ("c", "g", "keep", "r", 1)], "cluster_id string, filter_name string, outcome string, reason string, decisions bigint")
    assert got(read.decision_counts(d, r), "filter_name", "decisions") == [("f", 7), ("g", 1)]


def test_coverage(spark):
    t = {"api_resources": spark.createDataFrame([("", "pods"), ("", "nodes")], "api_group string, resource string"), "observations": spark.createDataFrame([("", "pods"), ("", "pods"), ("x", "things")], "api_group string, resource string")}
    assert got(read.coverage(t), "resource", "discovered", "observations") == [("nodes", True, 0), ("pods", True, 2), ("things", False, 1)]


def test_run_log(spark):
    run = lambda i, session, status, days: (i, session, status, "q", f"answer {i}", T0, T0 - timedelta(days=days))
    t = {"agent_sessions": spark.createDataFrame([("s1", "t", T0, T0), ("s2", "t", T0, T0 - MIN)], empty(spark, "agent_sessions").schema)}
    t["agent_runs"] = spark.createDataFrame([run("r1", "s1", "failed", 9), run("r2", "s1", "done", 8), run("r3", "s1", "failed", 1), run("r4", "s1", "failed", 0)], empty(spark, "agent_runs").schema)
    t["agent_run_events"] = spark.createDataFrame([(f"r{i}", 1, "e", "", T0) for i in range(1, 5)], empty(spark, "agent_run_events").schema)
    assert [tuple(r) for r in read.sessions(t).select("session_id", "runs", "last_run", "last_answer").collect()] == [("s1", 4, "r4", "answer r4"), ("s2", 0, None, None)]
    assert got(read.run_status_counts(t), "status", "runs") == [("done", 1), ("failed", 3)]
    kept = maintain.retain_runs(t, T0, timedelta(days=5))
    assert got(kept["agent_runs"], "run_id") == got(kept["agent_run_events"], "run_id") == [("r2",), ("r3",), ("r4",)]


def test_compaction(spark):
    v = spark.createDataFrame([("c", "a", 1), ("c", "a", 2)], "cluster_id string, object_id string, seq bigint").repartition(4)
    seen = spark.createDataFrame([("c", "a", 2), ("c", "a", 2)], "cluster_id string, object_id string, seq bigint")
    assert got(maintain.prune_unreferenced(v, seen), "seq") == [(2,)]
    with pytest.raises(ValueError):
        maintain.prune_unreferenced(v, seen.where("false"))
    keys = "hour timestamp, cluster_id string, filter_name string, outcome string, reason string, decisions bigint, first_at timestamp, last_at timestamp"
    counts = lambda n, at: spark.createDataFrame([(T0, "c", "f", "keep", "r", n, at, at)], keys)
    out = maintain.compact({"versions": v, "observations": seen}, counts(2, T0), counts(3, T0 + MIN), 1)
    assert out["versions"].rdd.getNumPartitions() == 1 and out["versions"].count() == 1
    assert got(out["decision_rollup"], "decisions", "first_at", "last_at") == [(5, T0, T0 + MIN)]


def test_pending_offsets(spark):
    o = spark.createDataFrame([("c", "", "pods", "", e, v, T0 + i * MIN) for i, (e, v) in enumerate([("watch", "1"), ("watch", "2"), ("listed", "0")])], "cluster_id string, api_group string, resource string, namespace string, event string, resource_version string, updated_at timestamp")
    assert got(sinks.coalesced_offsets(o), "event", "resource_version") == [("listed", "0"), ("watch", "2")]


def test_tables_by_ddl(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS upkeep")
    sinks.create_tables(spark, "upkeep")
    sinks.create_tables(spark, "upkeep")
    assert {"facts", "versions", "ingestion_offsets"} <= {r["tableName"] for r in spark.sql("SHOW TABLES IN upkeep").collect()}
    assert spark.table("upkeep.facts").columns[-1] == "month" and spark.table("upkeep.facts").count() == 0
    spark.sql("DROP DATABASE upkeep CASCADE")


def test_result_formats(spark):
    df = spark.createDataFrame([("a\tb", None), ("c\nd", 2)], "k string, n int")
    assert sinks.to_tsv(df) == "k\tn\na\\tb\t\nc\\nd\t2"
    assert sinks.to_text(df.where("n = 2")) == "k=c\nd n=2"
    assert sinks.to_tsv(df, 1).count("\n") == 1

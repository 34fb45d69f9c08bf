"""Reads, recipes and functions that no other test runs, on one small incident."""

import json
from datetime import datetime, timedelta

import pytest
from lorebase.functions.documents import json_remove_paths
from lorebase.functions.scalars import readable_size
from lorebase.operators import filters, read, sqlsurface, versions
from lorebase.plans import recipes
from lorebase.plans.ingest import canonical_ids, enriched, ingest
from lorebase.schema import empty, schema_drift
from lorebase.sources.documents import observations
from lorebase.sources.resolver import Resolver
from pyspark.sql import functions as F

from . import fixtures as fx

NOW = fx.T0 + timedelta(hours=1)


@pytest.fixture(scope="module")
def tables(spark):
    t = {k: v.cache() for k, v in ingest(observations(fx.decoded(spark))).items()}
    offset = ("c1", "", "v1", "pods", "Pod", True, "", "7", "watch", "ok", "", None, fx.T0, None, fx.T0)
    discovered = ("", "v1", "pods", "Pod", True, "", fx.T0), ("apps", "v1", "deployments", "Deployment", True, "", fx.T0)
    new = lambda name, *rows: spark.createDataFrame(list(rows), empty(spark, name).schema)
    return t | {"clusters": new("clusters", ("c1", "u", "test", fx.T0)), "api_resources": new("api_resources", *discovered), "ingestion_offsets": new("ingestion_offsets", offset)}


def test_newest_object_and_its_rows(spark, tables):
    assert read.latest_object(tables, "Pod")["name"] == "web-0"
    assert read.latest_object(tables, "Nothing")["kind"] == fx.INCIDENT[-1][0]["kind"]  # the newest of all
    assert read.latest_object(tables | {"versions": tables["versions"].where("false")}, "Pod") is None
    by_path = read.rows_of(tables, "facts", "c1", "c1/pods/shop/web-0")
    assert by_path.count() == read.rows_of(tables, "facts", "c1", "c1/pod-1").count() == tables["facts"].where("object_id = 'c1/pod-1'").count() > 0
    times = [r["ts"] for r in by_path.collect()]
    assert times == sorted(times)
    assert {r["edge_type"] for r in read.rows_of(tables, "edges", "c1", "c1/pod-1").collect()} >= {"pod_on_node", "owned_by"}


def test_bundle_of_one_object(spark, tables):
    (b,) = read.investigate(tables, read.Target("Pod", "shop", "web-0"), facts=2).collect()
    assert (b["object_id"], len(b["facts"]), [v["seq"] for v in b["versions"]]) == ("c1/pod-1", 2, [1, 2])
    assert json.loads(b["latest"])["status"]["containerStatuses"][0]["restartCount"] == 2
    assert {e["edge_type"] for e in b["edges"]} >= {"pod_on_node", "pod_uses_secret"}
    with pytest.raises(read.NotFound):
        read.investigate(tables, read.Target("Pod", "shop", "none"))


def test_documents_are_searched_on_request(spark, tables):
    find = lambda q, **o: {r["object_id"]: (r["score"], list(r["reasons"])) for r in read.search(tables, q, **o).collect()}
    assert find("envFrom") == {} and find("envFrom", documents=True) == {"c1/pod-1": (10, ["document"])}
    with_both, without = find("OOMKilled", documents=True)["c1/pod-1"], find("OOMKilled")["c1/pod-1"]
    assert with_both[0] == without[0] + 10 and set(with_both[1]) == {*without[1], "document"}
    assert find("OOMKilled", namespace="other", documents=True) == {}


def test_search_by_index_equals_the_scan(spark, tables, tmp_path):
    indexes = read.search_indexes(tables, str(tmp_path))
    rows = lambda q, **o: [tuple(map(str, r)) for r in read.search(tables, q, **o).collect()]
    for q in ("OOMKilled", "oomkilled pod_status", "web", "ab", "Ready False", "nothing-like-it", "'status' replace"):
        assert rows(q, indexes=indexes, documents=True) == rows(q, documents=True), q
    assert rows("OOMKilled", indexes=indexes)
    many = tables["facts"].where("fact_value = 'OOMKilled'").limit(1).crossJoin(spark.range(30)).withColumn("ts", F.timestamp_seconds(F.col("id"))).drop("id")
    capped = read.search(tables | {"facts": many, "changes": tables["changes"].where("false")}, "oomkilled", limit=1).first()  # 20 rows count of 30
    assert capped["score"] == 20 * (20 + many.first()["severity"]) and capped["latest"] == many.agg(F.max("ts")).first()[0]


def test_scores_by_severity(spark, tables):
    scores = {r["object_id"]: r["score"] for r in read.evidence_scores(tables, by_severity=True).collect()}
    want = {}
    for t, column, base in (("facts", "object_id", 1), ("changes", "object_id", 3)):
        for r in tables[t].collect():
            want[r[column]] = want.get(r[column], 0) + base + r["severity"]
    for r in read.canonical_edges(tables).collect():
        want[r["src_id"]] = want.get(r["src_id"], 0) + 1
    assert scores == want


def test_gauges_and_drift(spark, tables):
    streams = read.health(tables, NOW, exclude=("deployments.apps",))
    row = read.gauges(tables, streams).first()
    assert row["versions"] == tables["versions"].count() and row["facts"] == tables["facts"].count() and row["streams"] == streams.count()
    assert {(r["resource"], r["class"]) for r in streams.collect()} == {("pods", "ok")}
    assert {(r["resource"], r["class"]) for r in read.health(tables, NOW).collect()} == {("pods", "ok"), ("deployments", "not_started")}
    facts = tables["facts"]
    assert schema_drift(facts, "facts") == []
    assert schema_drift(facts.drop("detail").withColumns({"severity": F.lit("x"), "more": F.lit(1)}), "facts") == ["missing detail", "extra more", "type of severity: string"]


def test_stored_bytes(spark, tables, tmp_path):
    tables["facts"].coalesce(1).write.parquet(str(tmp_path / "f"))
    df = spark.read.parquet(str(tmp_path / "f"))
    size = sum(p.stat().st_size for p in (tmp_path / "f").glob("*.parquet"))
    assert tuple(read.stored_bytes(df).first()) == (1, size)


def test_enrichment_of_edges(spark, tables):
    schema = "cluster_id string, edge_type string, src_id string, dst_id string, src_kind string, dst_kind string, valid_from timestamp, valid_to timestamp, detail string"
    e = spark.createDataFrame([("c1", "a", "c1/x", "c1/pods/shop/web-0", "X", "", fx.T0, None, ""), ("c1", "b", "c1/x", "c1/apps/deployments/shop/d", "", "", fx.T0, None, ""), ("c1", "c", "c1/x", "c1/unknown", "X", "Kept", fx.T0, None, "")], schema)
    out = {r["edge_type"]: (r["dst_id"], r["dst_kind"]) for r in enriched(e, tables["object_aliases"], Resolver()).collect()}
    # a target by path goes by its uid, so its kind can't be told from the id any more; one without an alias keeps its path
    assert out == {"a": ("c1/pod-1", ""), "b": ("c1/apps/deployments/shop/d", "Deployment"), "c": ("c1/unknown", "Kept")}
    kinds = spark.createDataFrame([("pods", "Pod"), ("deployments", "Deployment")], "resource string, kind string")
    assert {r["edge_type"]: r["dst_kind"] for r in versions.infer_kinds(e, kinds).collect()} == {"a": "Pod", "b": "Deployment", "c": "Kept"}
    assert canonical_ids(tables["object_aliases"]).where("alias_id = 'c1/pods/shop/web-0'").first()["object_id"] == "c1/pod-1"


def test_decisions_of_the_columnar_policy(spark):
    schema = "ts timestamp, cluster_id string, filter_name string, outcome string, reason string, destructive boolean"
    d = spark.createDataFrame([(fx.T0, "c", "managed_fields", "keep_modified", "paths_removed", False), (fx.T0, "c", "other", "keep_modified", "x", False), (fx.T0, "c", "lease_skip", "discard_resource", "lease_skip", True)], schema)
    names = lambda df: sorted(r["filter_name"] for r in df.collect())
    detail, rollup = filters.persisted_decisions(d)
    assert names(detail) == ["lease_skip", "other"] and names(rollup) == ["managed_fields"]
    detail, rollup = filters.persisted_decisions(d, columnar=True)
    assert names(detail) == ["lease_skip"] and names(rollup) == []


def test_recipes_over_time(spark, tables):
    o = tables["observations"]
    none, later = fx.T0 - timedelta(days=1), fx.T0 + timedelta(days=1)
    (d,) = recipes.allocation_delta(o, none, later).collect()
    assert (d["namespace"], d["cpu_start"], d["cpu_delta"], d["memory_delta"]) == ("shop", 0.0, 0.5, float(1 << 30))
    schema = "cluster_id string, object_id string, path string, new_scalar string, ts timestamp"
    c = spark.createDataFrame([("c", "a", "spec.storage", "1Gi", fx.T0), ("c", "a", "spec.storage", "2Gi", NOW), ("c", "b", "spec.storage", "1Gi", fx.T0), ("c", "b", "spec.storage", "1Gi", NOW), ("c", "a", "other", "x", NOW)], schema)
    assert [(r["object_id"], list(r["values"]), r["first_ts"], r["last_ts"]) for r in recipes.resize_candidates(c).collect()] == [("a", ["1Gi", "2Gi"], fx.T0, NOW)]
    assert [r["seq"] for r in recipes.object_proof(tables["versions"], "c1/pod-1", 1).collect()] == [2]
    assert [r["severity"] for r in recipes.severe_facts(tables["facts"], 90).collect()] == [90] * tables["facts"].where("severity >= 90").count()
    assert recipes.degraded_streams(tables["ingestion_offsets"]).count() == 0
    assert recipes.degraded_streams(tables["ingestion_offsets"].withColumn("status", F.lit("error"))).count() == 1


def test_chains_by_name(spark, tables):
    known = read.objects(tables["versions"])
    edges = read.canonical_edges(tables)
    assert recipes.rbac_chain(edges, known).count() == 0  # the role isn't known
    role = spark.createDataFrame([("c1", "c1/rbac.authorization.k8s.io/clusterroles/admin", "ClusterRole", "", "admin")], "cluster_id string, object_id string, kind string, namespace string, name string")
    hook = spark.createDataFrame([("c1", "c1/services/sys/hook", "Service", "sys", "hook")], role.schema)
    more = known.select(*role.columns).unionByName(role).unionByName(hook)
    assert [(r["source_name"], r["edge_type"], r["target_name"]) for r in recipes.rbac_chain(edges, more).collect()] == [("rb", "rbac_binding_grants_role", "admin")]
    assert [(r["source_kind"], r["target_namespace"], r["target_name"]) for r in recipes.webhook_services(edges, more).collect()] == [("ValidatingWebhookConfiguration", "sys", "hook")]
    assert recipes.certificate_chain(edges, more).count() == 0


def test_functions(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (1023,), (1536,), (1 << 30,), (5 << 50,)], "n long").select(readable_size(F.col("n"))).collect()] == ["0.00 B", "1,023.00 B", "1.50 KiB", "1.00 GiB", "5,120.00 TiB"]
    docs = spark.createDataFrame([('{"a": {"b": 1, "c": 2}}',), ("{",), (None,)], "doc string")
    out = [r["x"] for r in docs.select(json_remove_paths(F.col("doc"), ["/a/b", "/z"]).alias("x")).collect()]
    assert json.loads(out[0]["doc"]) == {"a": {"c": 2}} and out[0]["removed"] == 1 and out[1]["doc"] == "{" and out[2]["removed"] == 0
    sqlsurface.register_functions(spark)
    assert spark.sql("SELECT fnv1a64('a')").first()[0] == "af63dc4c8601ec8c"
    rows = [{"k": "a", "n": 2}, {"k": "b", "n": None}, {"k": "a", "n": True}]
    assert sqlsurface.sum_by(rows, "k", "n") == {"a": 2, "b": 0} and [r["n"] for r in sqlsurface.sort_by(rows, "n")][-1] is None
    assert sqlsurface.uniq_by(rows, "k") == rows[:2] and sqlsurface.pick(rows, "k") == [{"k": "a"}, {"k": "b"}, {"k": "a"}]
    assert datetime(2024, 1, 1) < NOW

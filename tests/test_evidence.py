"""Fixtures through ingest, extractors, reads and maintenance."""

import json
from datetime import datetime, timedelta

import pytest
from lorebase.functions.documents import differences, remove_path
from lorebase.functions.scalars import fnv1a64_text, glob_to_regex, quantity_to_double
from lorebase.operators import maintain, profiles, read, sqlsurface, versions
from lorebase.operators.extract import unreadable
from lorebase.operators.filters import apply_chains, decision_rows, kept, merge_rollups, persisted_decisions
from lorebase.plans import recipes
from lorebase.plans.ingest import ingest
from lorebase.schema import TABLES
from lorebase.sources.documents import decode, observations, read_documents
from lorebase.sources.resolver import Resolver, plural
from pyspark.sql import functions as F

from . import fixtures as fx


@pytest.fixture(scope="module")
def tables(spark):
    t = ingest(observations(fx.decoded(spark)))
    return {k: v.cache() for k, v in t.items()}


def facts_of(tables, object_id):
    return {(r["fact_key"], r["fact_value"]): r["severity"] for r in tables["facts"].where(F.col("object_id") == object_id).collect()}


def test_incident_facts(tables):
    pod = facts_of(tables, "c1/pod-1")
    assert pod["pod_status.last_reason", "OOMKilled"] == 90 and pod["pod_status.reason", "CrashLoopBackOff"] == 90
    assert pod["pod_status.restart_count", "2"] == 30 and pod["pod_status.ready", "False"] == 50
    node = facts_of(tables, "c1/node-1")
    assert node["node_condition.MemoryPressure", "True"] == 80 and node["node_condition.Ready", "False"] == 20
    event = facts_of(tables, "c1/ev-1")
    assert ("k8s_event.count", "4") in event and ("k8s_event.reason", "BackOff") in event
    assert facts_of(tables, "c1/wh-1")["admission_webhook.failure_policy", "Fail"] == 70
    numbers = {r["fact_key"]: r["numeric_value"] for r in tables["facts"].where("object_id = 'c1/node-1' AND numeric_value IS NOT NULL").collect()}
    assert numbers["node_capacity.memory"] == 16380048 * 1024 and numbers["node_allocatable.cpu"] == pytest.approx(3.92)


def test_incident_edges(tables):
    e = {(r["edge_type"], r["dst_id"]) for r in tables["edges"].collect()}
    assert {
        ("pod_on_node", "c1/nodes/n1"), ("pod_uses_secret", "c1/secrets/shop/cred"), ("pod_uses_pvc", "c1/persistentvolumeclaims/shop/disk"), ("pod_uses_configmap", "c1/configmaps/shop/conf"),
        ("owned_by", "c1/apps/replicasets/shop/web-rs"), ("endpointslice_for_service", "c1/services/shop/web"), ("endpointslice_targets_pod", "c1/pods/shop/web-0"), ("event_involves_object", "c1/pods/shop/web-0"),
        ("rbac_binding_grants_role", "c1/rbac.authorization.k8s.io/clusterroles/admin"), ("rbac_binding_binds_subject", "c1/serviceaccounts/shop/sa"), ("webhook_uses_service", "c1/services/sys/hook"),
    } <= e
    assert all(r["valid_to"] is None for r in tables["edges"].collect())


def test_secret_payload_and_decisions(tables):
    payload = set(fx.SECRET["data"].values())
    for name, df in tables.items():
        held = [str(r.asDict()) for r in df.collect()]
        assert not any(x in h for x in payload for h in held), name
    doc = tables["versions"].where("kind = 'Secret'").first()["doc"]
    assert "data" not in json.loads(doc)
    raw = tables["latest_raw"].where("kind = 'Secret'").first()["doc"]
    assert json.loads(raw)["data"] == dict.fromkeys(fx.SECRET["data"], "<redacted>")
    assert {r["reason"] for r in tables["filter_decisions"].collect()} == {"secret_payload_removed"}
    d = {r["filter_name"] for r in tables["filter_rollup"].collect()}
    assert "resource_version" in d and "status_condition_set" in d


def test_malformed_documents(spark):
    """One odd document neither stops the job nor keeps others from their evidence."""
    meta = {"name": "x", "namespace": "shop", "uid": "u-odd"}
    odd = [
        ("Pod", "pods", {"metadata": "m", "status": {"containerStatuses": ["a", 3], "conditions": ["c", {"type": "Ready", "status": 1}]}, "spec": "s"}),
        ("Service", "services", {"metadata": meta, "spec": "s", "status": {"loadBalancer": {"ingress": ["i", {"ip": 7}]}}}),
        ("EndpointSlice", "endpointslices", {"metadata": {"labels": "l"}, "endpoints": ["a", {"targetRef": "t", "conditions": []}]}),
        ("RoleBinding", "rolebindings", {"metadata": meta, "roleRef": "r", "subjects": ["s", {"kind": 1}]}),
        ("ValidatingWebhookConfiguration", "validatingwebhookconfigurations", {"metadata": meta, "webhooks": ["a", {"clientConfig": {"service": "s"}}]}),
        ("ConfigMap", "configmaps", {"metadata": "m", "data": {"status": 5}}),
        ("Secret", "secrets", {"metadata": meta, "data": 5, "stringData": ["p"]}),
        ("Node", "nodes", ["not", "a", "map"]),
    ]
    base = observations(fx.decoded(spark, [(fx.POD_READY, 0)]))
    rows = base
    for kind, resource, doc in [*odd, ("Pod", "pods", None), ("Secret", "secrets", "broken")]:
        text = "{broken" if doc == "broken" else None if doc is None else json.dumps(doc)
        rows = rows.unionByName(base.withColumns({"kind": F.lit(kind), "resource": F.lit(resource), "name": F.lit(f"odd-{kind}"), "uid": F.lit(f"odd-{kind}"), "doc": F.lit(text).cast("string")}))
    t = ingest(rows)
    assert t["versions"].where("doc LIKE '%broken%' OR doc LIKE '%stringData%'").count() == 0
    assert t["facts"].where("name = 'odd-Pod'").count() == 0 and t["facts"].where("name NOT LIKE 'odd-%'").count() > 0
    assert {(r["resource"], r["rows"]) for r in unreadable(rows).collect()} == {("nodes", 1), ("pods", 1), ("secrets", 1)}


def test_profiles(spark):
    rows = [("", "pods", "Pod"), ("events.k8s.io", "events", "Event"), ("", "secrets", "Secret"), ("batch", "cronjobs", "CronJob"), ("argoproj.io", "rollouts", "Rollout"), ("coordination.k8s.io", "leases", "Lease"), ("x.io", "pods", "Pod"), (None, None, None)]
    got = [(r["profile"], r["chain"], r["extractor_set"]) for r in profiles.with_profile(spark.createDataFrame(rows, "api_group string, resource string, kind string")).collect()]
    generic = ("generic", "default", "generic")
    assert got == [("pod_fast_path", "default", "pod"), ("event_rollup", "event_rollup", "event"), ("secret_metadata_only", "secret_metadata_only", "secret_metadata"), ("workload_rollout", "default", "workload"), generic, generic, generic, generic]


def test_ties_have_one_order(spark):
    """Rows of one time are taken by their document's hash, however they lie."""
    at = datetime(2024, 1, 1)
    rows = [("c1", "o", at, "MODIFIED", h) for h in ("b", "a", "c", "a", "b")] + [("c1", "o", at + timedelta(seconds=1), "MODIFIED", "c")]
    df = spark.createDataFrame(rows, "cluster_id string, object_id string, observed_at timestamp, observation_type string, doc_hash string")
    seen = {tuple((r["doc_hash"], r["content_changed"], r["seq"]) for r in versions.changed(df.repartition(n, "doc_hash")).orderBy("seq", "doc_hash", F.desc("content_changed")).collect()) for n in (1, 3, 5)}
    assert seen == {(("a", True, 1), ("a", False, 1), ("b", True, 2), ("b", False, 2), ("c", True, 3), ("c", False, 3))}


def test_secret_chain_and_scope(spark):
    obs = observations(fx.decoded(spark, [(fx.SECRET, 0), (fx.NODE, 1)]))
    out = apply_chains(obs, chain=F.when(F.col("kind") == "Secret", "secret_metadata_only").otherwise("no such chain"))
    rows = {r["kind"]: r for r in out.collect()}
    assert "data" not in json.loads(rows["Secret"]["doc"]) and rows["Secret"]["outcome"] == "keep_modified"
    assert [c["type"] for c in json.loads(rows["Node"]["doc"])["status"]["conditions"]] == ["MemoryPressure", "Ready"]
    detail, rollup = persisted_decisions(decision_rows(out))
    assert {r["reason"] for r in detail.collect()} == {"secret_payload_removed"}
    assert merge_rollups(rollup, rollup).agg(F.sum("decisions")).first()[0] == 2 * rollup.agg(F.sum("decisions")).first()[0]


def test_discard_keeps_deletions(spark):
    from lorebase.operators.filters import DISCARD_CHANGE, static

    obs = observations(fx.decoded(spark, [(fx.POD_READY, 0), (fx.POD_READY, 1)], {1: "DELETED"}))
    out = apply_chains(obs, {"default": [static("drop", DISCARD_CHANGE)]})
    assert [r["observation_type"] for r in kept(out).collect()] == ["DELETED"]


def test_unchanged_and_normalized(spark):
    churn = json.loads(json.dumps(fx.NODE))
    churn["status"]["conditions"] = [dict(c, lastHeartbeatTime="y") for c in reversed(churn["status"]["conditions"])]
    churn["metadata"]["resourceVersion"] = "9"
    t = ingest(observations(fx.decoded(spark, [(fx.NODE, 10), (churn, 20)])))
    s = read.history_summary(t["observations"]).first()
    assert (s["versions"], s["observations"], s["unchanged"]) == (1, 2, 1)


def test_readd_after_delete(spark):
    items = [(fx.POD_READY, 0), (fx.POD_READY, 1), (fx.POD_READY, 2)]
    for readd, n in ((True, 3), (False, 2)):
        t = ingest(observations(fx.decoded(spark, items, {1: "DELETED"})), readd_versions=readd)
        assert t["versions"].count() == n
    prior = versions.prior_state(versions.changed(versions.with_identity(observations(fx.decoded(spark, items[:2], {1: "DELETED"}))), True))
    later = versions.changed(versions.with_identity(observations(fx.decoded(spark, items[2:]))), True, prior=prior).first()
    assert later["content_changed"] and later["seq"] == 3


def test_history_and_diff(spark):
    conf = lambda mode: {"apiVersion": "v1", "kind": "ConfigMap", "metadata": {"name": "m", "namespace": "d", "uid": "u"}, "data": {"mode": mode}}
    t = ingest(observations(fx.decoded(spark, [(conf("prod"), 10), (conf("prod"), 20), (conf("dev"), 30)])))
    h = read.history(t, t["observations"], read.Target("ConfigMap", "d", "m"))
    assert [r["observation_count"] for r in h["versions"].collect()] == [1, 2]
    diff = h["diffs"].first()
    assert [(c["path"], c["old"], c["new"]) for c in diff["changes"]] == [("/data/mode", "prod", "dev")] and not diff["truncated"]


def test_find_and_ambiguous(spark, tables):
    assert read.find_object(tables, read.Target("Pod", "shop", "web-0"))["object_id"] == "c1/pod-1"
    with pytest.raises(read.NotFound):
        read.find_object(tables, read.Target("Pod", "shop", "none"))
    two = tables | {"versions": tables["versions"].union(tables["versions"].withColumn("cluster_id", F.lit("c2")))}
    with pytest.raises(read.Ambiguous):
        read.find_object(two, read.Target("Pod", "shop", "web-0"))


def test_service_investigation(tables):
    rows = read.service_investigation(tables, "shop", "web").collect()
    assert rows[0]["kind"] == "Service" and rows[0]["rank"] == 1
    assert {r["kind"] for r in rows} == {"Service", "EndpointSlice", "Pod", "Node", "Event"}
    pod = next(r for r in rows if r["kind"] == "Pod")
    assert len(pod["versions"]) == 2 and any(f["fact_value"] == "OOMKilled" for f in pod["facts"])


def test_search_and_topology(tables):
    hits = read.search(tables, "oomkilled").collect()
    assert hits[0]["object_id"] == "c1/pod-1" and hits[0]["score"] == 110 + 105
    nodes, edges = read.topology(tables, "c1", "c1/pod-1")
    assert {"in", "out"} == {r["direction"] for r in edges.collect()}
    assert {"Node", "EndpointSlice", "Event"} <= {r["kind"] for r in nodes.collect()}


def test_recipes(tables):
    o = tables["observations"]
    assert recipes.endpoint_readiness(o).first().asDict() == {"cluster_id": "c1", "namespace": "shop", "service": "web", "slices": 1, "endpoints": 1, "ready": 0}
    assert recipes.node_capacity(o).first()["capacity_memory_n"] == 16380048 * 1024
    a = recipes.allocation_rollup(o).first()
    assert (a["containers"], a["cpu_requests"], a["memory_requests"]) == (1, 0.5, 2.0**30)
    assert recipes.event_objects(tables["facts"], tables["edges"]).first()["reason"] == "BackOff"
    assert recipes.reason_by_namespace(tables["facts"]).first()["pods"] == 1
    assert recipes.restarts_by_namespace(tables["facts"]).first()["restarts"] == 2
    assert recipes.coverage_latest(o).count() == 8
    assert recipes.service_topology_counts(tables["edges"]).first()["pods"] == 1
    assert recipes.doc_fields(tables["versions"]).where("field = 'spec'").count() == 2


def test_health(spark, tables):
    offsets = spark.createDataFrame(
        [("c1", "", "v1", "pods", "Pod", True, "", "5", "watch", "retrying", "", fx.T0, fx.T0, None, fx.T0), ("c1", "", "v1", "nodes", "Node", False, "", "5", "list", "error", "boom", fx.T0, None, None, fx.T0), ("c1", "", "v1", "services", "Service", True, "", "5", "list", "queued", "", fx.T0, None, None, fx.T0)],
        TABLES["ingestion_offsets"],
    )
    resources = spark.createDataFrame([("", r) for r in ("pods", "nodes", "services", "secrets")], "api_group string, resource string")
    clusters = spark.createDataFrame([("c1",)], "name string")
    h = read.health(tables | {"ingestion_offsets": offsets, "api_resources": resources, "clusters": clusters}, fx.T0 + timedelta(days=2))
    by = {r["resource"]: r["class"] for r in h.collect()}
    assert by == {"pods": "unstable", "nodes": "error", "services": "queued", "secrets": "not_started"}
    s = read.health_summary(h).first()
    assert (s["streams"], s["error"], s["unstable"], s["queued"], s["not_started"], s["complete"]) == (4, 1, 1, 1, 1, False)
    assert read.health_problems(h, 2).count() == 2


def test_retention(tables):
    now = fx.T0 + timedelta(days=2)
    kept_tables = maintain.retain(tables, now, [maintain.Rule(timedelta(hours=24), 1)], timedelta(hours=1))
    assert kept_tables["versions"].where("object_id = 'c1/pod-1'").count() == 1
    assert kept_tables["facts"].where("object_id = 'c1/pod-1' AND fact_value = 'True'").count() == 0
    assert kept_tables["filter_decisions"].count() == 0
    assert maintain.retain(tables, now, [maintain.Rule(timedelta(hours=24), 1, resource="node*")])["versions"].count() == tables["versions"].count()


def test_sql_guard(spark, tables):
    sqlsurface.register_views({"versions": tables["versions"]})
    for ok in ("select 1", "with a as (select 1 as x) select x from a", "explain select 1", "show tables", "select 'drop table versions'", "describe versions", "select count(*) from versions where kind in (select kind from versions)"):
        sqlsurface.check_read_only(spark, ok)
    for bad in ("drop table versions", "select 1; select 2", "insert into versions select * from versions", "set a=b", "cache table versions", "with a as (select 1) insert into versions select * from a", "select java_method('java.lang.System', 'exit', 0)", "select * from parquet.`/tmp`", "explain drop table versions", "select (select reflect('a', 'b'))"):
        with pytest.raises(sqlsurface.Refused):
            sqlsurface.check_read_only(spark, bad)
    r = sqlsurface.query_sql(spark, "select kind from versions order by kind", 3)
    assert r.truncated and r.row_count == 3 and r.columns == ["kind"]
    out = sqlsurface.run_script(lambda s: sqlsurface.count_by(s.sql("select kind from versions"), "kind"), spark, timeout_s=8)
    assert out["Pod"] == 2
    with pytest.raises(sqlsurface.Refused):
        sqlsurface.run_script(lambda s: s.sql_all(["select 1"] * 7), spark, timeout_s=8)
    assert "recipes" in sqlsurface.query_schema()


def test_relist(spark):
    ref = lambda *names: observations(fx.decoded(spark, [({"apiVersion": "v1", "kind": "Pod", "metadata": {"name": n, "namespace": ns}}, 0) for ns, n in names]))
    gone, unknown = versions.relist_deletes(ref(("a", "keep"), ("a", "gone"), ("b", "other")), ref(("a", "keep")), "a")
    assert [r["name"] for r in gone.collect()] == ["gone"] and unknown.count() == 1


def test_decode(spark, tmp_path):
    (tmp_path / "c9").mkdir()
    (tmp_path / "c9" / "a.json").write_text(json.dumps({"items": [fx.NODE, {"type": "deleted", "object": fx.SERVICE}]}))
    rows = read_documents(spark, str(tmp_path), cluster_part=1)
    assert {(r["cluster_id"], r["observation_type"]) for r in rows.collect()} == {("c9", "MODIFIED"), ("c9", "DELETED")}
    with pytest.raises(Exception, match="not an object"):
        decode(spark.createDataFrame([('{"items": [1]}',)], "value string")).collect()


def test_streaming_equals_batch(spark, tmp_path):
    from lorebase.streaming.ingest import run_available, version_stream

    items = [(fx.POD_READY, 0), (fx.POD_READY, 1), (fx.POD_DOWN, 2), (fx.POD_DOWN, 3), (fx.NODE, 4)]
    obs = observations(fx.decoded(spark, items, {3: "DELETED"}))
    for i in (0, 2, 4):
        obs.where((F.minute("observed_at") >= i) & (F.minute("observed_at") < i + 2)).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in")
    run_available(version_stream(stream, True), f"{tmp_path}/out", f"{tmp_path}/cp", lambda b: {"versions": b.where("content_changed")})
    got = {(r["object_id"], r["seq"], r["doc_hash"]) for r in spark.read.parquet(f"{tmp_path}/out/versions").collect()}
    want = {(r["object_id"], r["seq"], r["doc_hash"]) for r in versions.versions(versions.changed(versions.with_identity(obs), True)).collect()}
    assert got == want and len(got) == 4


def test_small_functions(spark):
    doc = {"a": {"b": 1, "c": [{"x": 1, "y": 2}, {"x": 3}]}, "k/v": 1}
    assert remove_path(doc, ["a", "c", "*", "x"]) == 2 and remove_path(doc, ["a", "c", "0"]) == 0 and doc["a"]["c"] == [{"y": 2}, {}]
    assert [d[:2] for d in differences({"a": 1, "b/": [1]}, {"a": 2, "b/": [2], "c": 0})] == [("/a", "replace"), ("/b~1", "replace"), ("/c", "add")]
    assert fnv1a64_text("") == "cbf29ce484222325" and fnv1a64_text("a") == "af63dc4c8601ec8c"
    assert plural("Ingress") == "ingresses" and plural("NetworkPolicy") == "networkpolicies" and Resolver().by_kind("", "Deployment").group == "apps"
    assert glob_to_regex("a*[!b]?.c") == r"^a.*[^b].\.c$"
    with pytest.raises(ValueError, match="bracket"):
        glob_to_regex("a[b")
    q = spark.createDataFrame([("500m",), ("2Ki",), ("1e3",), ("x",), ("7",)], "q string").select(quantity_to_double(F.col("q")).alias("n")).collect()
    assert [r["n"] for r in q] == [0.5, 2048.0, 1000.0, None, 7.0]
    assert read.resolve_cluster(["gke-prod-eu", "gke-dev-eu"], "prod") == "gke-prod-eu"
    with pytest.raises(read.Ambiguous):
        read.resolve_cluster(["gke-prod-eu", "gke-dev-eu"], "eu")


def test_generate(spark):
    from lorebase.sources.generate import generate

    pod = lambda ready: {"apiVersion": "v1", "kind": "Pod", "metadata": {"name": "p-@copy@", "namespace": "d", "uid": "u-@copy@"}, "status": {"conditions": [{"type": "Ready", "status": ready}]}}
    rows = generate(spark, [[pod("True"), pod("False")], [fx.NODE]], fx.T0, clusters=2, copies=3)
    t = ingest(observations(rows))
    assert rows.count() == 2 * 3 * 3
    assert t["versions"].count() == 2 * (3 * 2 + 1)
    assert recipes.coverage_latest(t["observations"]).where("kind = 'Pod'").agg(F.sum("objects")).first()[0] == 6

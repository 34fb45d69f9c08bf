"""Items of documents, and evidence from them by rules."""

import json
from datetime import datetime

from lorebase.operators import extract
from lorebase.sources.resolver import BUILT_IN, Resolver, plural, plural_of
from pyspark.sql import functions as F

SCHEMA = "cluster_id string, observed_at timestamp, object_id string, kind string, namespace string, name string, observation_type string, doc string"


def _rows(spark, *docs):
    return spark.createDataFrame([("c1", datetime(2024, 1, 1), f"o{i}", kind, "ns", "n", "ADDED", doc if isinstance(doc, str | None) else json.dumps(doc)) for i, (kind, doc) in enumerate(docs)], SCHEMA)


def test_items_of():
    doc = {"status": {"phase": "Running", "conditions": [{"type": "Ready", "status": "True"}, None, "x"]}, "status.phase": "no", "spec": {"nodeName": 4, "volumes": {"secret": 1}}}
    items = {x["path"]: x for x in extract.items_of(json.dumps(doc), "Pod")}
    assert dict(items[""]["strings"]) == {"status.phase": "Running"} and dict(items[""]["numbers"]) == {"spec.nodeName": 4.0}
    assert [dict(x["strings"]) for x in extract.items_of(json.dumps(doc), "Pod") if x["path"] == "status.conditions[*]"] == [{"type": "Ready", "status": "True"}, {}]
    assert all(extract.items_of(d, "Pod") == [] for d in (None, "", "{", "[1]", "3", "null", "[" * 100_000))


def test_rules_meet_items(spark):
    hook = {"webhooks": [{"name": "h", "failurePolicy": "Fail", "clientConfig": {"service": {"name": "s", "namespace": "other"}}}]}
    binding = {"roleRef": {"kind": "ClusterRole", "name": "r"}, "subjects": [{"kind": "User", "name": "u"}, {"kind": "ServiceAccount", "name": "sa"}, {"kind": "Policy", "name": "p", "namespace": "x"}]}
    points = {"metadata": {"labels": {"kubernetes.io/service-name": "web"}}, "endpoints": [{"targetRef": {"kind": "Pod", "name": "p1"}, "conditions": {"ready": False}}]}
    out = extract.evidence(_rows(spark, ("MutatingWebhookConfiguration", hook), ("RoleBinding", binding), ("EndpointSlice", points), ("Pod", None), ("Pod", "{")))
    facts, edges, changes = ([tuple(r) for r in x.select(*c).collect()] for x, c in zip(out, (("object_id", "fact_key", "fact_value", "severity"), ("edge_type", "dst_id"), ("path", "new_scalar")), strict=True))
    assert sorted(facts) == [
        ("o0", "admission_webhook.failure_policy", "Fail", 70), ("o0", "admission_webhook.name", "h", 40), ("o0", "admission_webhook.service", "other/s", 50),
        ("o1", "rbac.role_ref", "ClusterRole/r", 50), ("o1", "rbac.subject", "Policy/x/p", 40), ("o1", "rbac.subject", "ServiceAccount/ns/sa", 40), ("o1", "rbac.subject", "User/u", 40), ("o2", "endpoint.ready", "false", 20),
    ]
    assert sorted(edges) == [
        ("endpointslice_for_service", "c1/services/ns/web"), ("endpointslice_targets_pod", "c1/pods/ns/p1"), ("rbac_binding_binds_subject", "c1/policies/x/p"), ("rbac_binding_binds_subject", "c1/rbac.authorization.k8s.io/users/u"),
        ("rbac_binding_binds_subject", "c1/serviceaccounts/ns/sa"), ("rbac_binding_grants_role", "c1/rbac.authorization.k8s.io/clusterroles/r"), ("webhook_uses_service", "c1/services/other/s"),
    ]
    assert ("endpoints.p1.conditions.ready", "false") in changes and ("endpoints.targetRef", "Pod/p1") in changes and ("webhooks.h.failurePolicy", "Fail") in changes


def test_nothing_is_shuffled(spark):
    for x in extract.evidence(_rows(spark, ("Pod", {}))):
        assert "Exchange hashpartitioning" not in x._jdf.queryExecution().executedPlan().toString()


def test_plural(spark):
    kinds = sorted({k.removeprefix("~") for of in BUILT_IN.values() for k in of.split()} | {"Policy", "Proxy", "Gateway", "Y", "Box", "Match", "Endpoints"})
    got = spark.createDataFrame([(k,) for k in kinds], "k string").select("k", plural_of(F.col("k")).alias("p")).collect()
    assert {r["k"]: r["p"] for r in got} == {k: plural(k) for k in kinds}
    assert ("", "Pod", "", "pods", True) in Resolver().lookup()

"""Extractors: facts, edges and changes of documents.

A document is parsed once into its items: itself, and the elements of lists that a rule reads, each with its scalar members by path. All
else is DataFrame work: items are exploded, edges come from joining them to a table of rules and to the resource table, facts and changes are
expressions over an item and the few values of its document that they need. Nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fnv1a64, quantity_to_double
from ..sources.resolver import Resolver, plural_of

#: Severities of container reasons.
SEVERE = ("OOMKilled", "CrashLoopBackOff", "Error", "Evicted")
#: Kinds of resources up to which their table is broadcast.
MOST_KINDS = 100_000


@dataclass(frozen=True)
class Target:
    """An edge of objects of kinds to what a path leads to: a name, or a map with name_key. own: in the object's namespace."""

    kinds: tuple[str, ...]
    path: str
    edge: str
    kind: str
    group: str = ""
    name_key: str = "name"
    own: bool = True


_WORKLOADS = ("Deployment", "ReplicaSet", "DaemonSet", "StatefulSet", "Job")
_ROUTES = ("HTTPRoute", "GRPCRoute", "TCPRoute", "TLSRoute", "UDPRoute")


def _pod_targets(kinds: tuple[str, ...], at: str, prefix: str) -> list[Target]:
    """What a pod spec refers to."""
    t = [Target(kinds, f"{at}.serviceAccountName", f"{prefix}_uses_serviceaccount", "ServiceAccount"), Target(kinds, f"{at}.imagePullSecrets[*]", f"{prefix}_uses_secret", "Secret")]
    v = f"{at}.volumes[*]"
    for path, edge, kind, key in (("secret", "secret", "Secret", "secretName"), ("configMap", "configmap", "ConfigMap", "name"), ("persistentVolumeClaim", "pvc", "PersistentVolumeClaim", "claimName"), ("projected.sources[*].secret", "secret", "Secret", "name"), ("projected.sources[*].configMap", "configmap", "ConfigMap", "name")):
        t.append(Target(kinds, f"{v}.{path}", f"{prefix}_uses_{edge}", kind, name_key=key))
    for c in ("initContainers", "containers", "ephemeralContainers"):
        for path, edge, kind in (("envFrom[*].secretRef", "secret", "Secret"), ("envFrom[*].configMapRef", "configmap", "ConfigMap"), ("env[*].valueFrom.secretKeyRef", "secret", "Secret"), ("env[*].valueFrom.configMapKeyRef", "configmap", "ConfigMap")):
            t.append(Target(kinds, f"{at}.{c}[*].{path}", f"{prefix}_uses_{edge}", kind))
    return t


TARGETS: list[Target] = [
    *_pod_targets(("Pod",), "spec", "pod"),
    *_pod_targets(_WORKLOADS, "spec.template.spec", "workload_template"),
    *_pod_targets(("CronJob",), "spec.jobTemplate.spec.template.spec", "workload_template"),
    Target(("Pod",), "spec.nodeName", "pod_on_node", "Node", own=False),
    Target(("ServiceAccount",), "secrets[*]", "serviceaccount_uses_secret", "Secret"),
    Target(("ServiceAccount",), "imagePullSecrets[*]", "serviceaccount_uses_imagepullsecret", "Secret"),
    Target(("Ingress",), "spec.defaultBackend.service", "ingress_routes_to_service", "Service"),
    Target(("Ingress",), "spec.rules[*].http.paths[*].backend.service", "ingress_routes_to_service", "Service"),
    Target(("PersistentVolumeClaim",), "spec.volumeName", "pvc_bound_to_pv", "PersistentVolume", own=False),
    Target(("PersistentVolumeClaim",), "spec.storageClassName", "pvc_uses_storageclass", "StorageClass", "storage.k8s.io", own=False),
    Target(("PersistentVolume",), "spec.storageClassName", "pv_uses_storageclass", "StorageClass", "storage.k8s.io", own=False),
    Target(("Gateway",), "spec.gatewayClassName", "gateway_uses_gatewayclass", "GatewayClass", "gateway.networking.k8s.io", own=False),
    Target(("Certificate",), "spec.secretName", "certmanager_writes_secret", "Secret"),
    Target(("Certificate",), "spec.privateKeySecretRef", "certmanager_uses_private_key_secret", "Secret"),
    Target(("CertificateRequest",), "spec.certificateRef", "certmanager_references_certificate", "Certificate", "cert-manager.io"),
    Target(("Order",), "spec.certificateRequestRef", "certmanager_references_certificaterequest", "CertificateRequest", "cert-manager.io"),
    Target(("Challenge",), "spec.orderRef", "certmanager_references_order", "Order", "acme.cert-manager.io"),
]


@dataclass(frozen=True)
class Reference:
    """An edge to what a reference map names itself: group (or apiVersion), kind, namespace, name; with what is taken where a part is missing."""

    kinds: tuple[str, ...]
    path: str
    edge: str
    kind: str = ""
    group: str = ""
    cluster_wide: tuple[str, ...] = ()


REFERENCES: list[Reference] = [
    Reference((), "metadata.ownerReferences[*]", "owned_by"),
    Reference(("HorizontalPodAutoscaler",), "spec.scaleTargetRef", "hpa_scales_target"),
    Reference(("PersistentVolume",), "spec.claimRef", "pv_bound_to_pvc", "PersistentVolumeClaim"),
    Reference(_ROUTES, "spec.parentRefs[*]", "gateway_route_attaches_to_parent", "Gateway", "gateway.networking.k8s.io"),
    Reference(_ROUTES, "spec.backendRefs[*]", "gateway_route_uses_backend", "Service"),
    Reference(_ROUTES, "spec.rules[*].backendRefs[*]", "gateway_route_uses_backend", "Service"),
    Reference(("RoleBinding", "ClusterRoleBinding"), "roleRef", "rbac_binding_grants_role", "Role", "rbac.authorization.k8s.io", ("ClusterRole",)),
    Reference(("Certificate", "CertificateRequest"), "spec.issuerRef", "certmanager_uses_issuer", "Issuer", "cert-manager.io", ("ClusterIssuer",)),
    Reference(("Event",), "involvedObject", "event_involves_object"),
    Reference(("Event",), "regarding", "event_regarding_object"),
    Reference(("Event",), "related", "event_related_object"),
]
#: Services behind webhooks (E9): kinds, path of the service map, edge, fact key.
SERVICES = [
    (("CustomResourceDefinition",), "spec.conversion.webhook.clientConfig.service", "crd_conversion_webhook_uses_service", "crd_conversion_webhook.service"),
    (("APIService",), "spec.service", "apiservice_uses_service", "apiservice.service"),
    (("ValidatingWebhookConfiguration", "MutatingWebhookConfiguration"), "webhooks[*].clientConfig.service", "webhook_uses_service", "admission_webhook.service"),
]
_HOOKS = ("ValidatingWebhookConfiguration", "MutatingWebhookConfiguration")
#: Plain facts: extractor, kinds, path, key, severity.
FACTS = [
    ("pod", ("Pod",), "status.phase", "pod_status.phase", 10),
    ("pod", ("Pod",), "spec.nodeName", "pod_placement.node_assigned", 20),
    ("event", ("Event",), "reason", "k8s_event.reason", 40),
    ("event", ("Event",), "type", "k8s_event.type", 20),
    ("event", ("Event",), "action", "k8s_event.action", 20),
    *(("event", ("Event",), p, "k8s_event.reporting_controller", 20) for p in ("reportingController", "reportingComponent", "source.component")),
    *(("event", ("Event",), p, "k8s_event.reporting_instance", 20) for p in ("reportingInstance", "source.host")),
    ("reference", _HOOKS, "webhooks[*].name", "admission_webhook.name", 40),
    ("service", ("Service",), "spec.type", "service.type", 10),
]
#: Named sets of extractors, as in profiles; what isn't listed gives nothing.
SETS: dict[str, tuple[str, ...]] = {
    "default": ("reference", "pod", "node", "event", "endpointslice", "service"),
    "pod": ("reference", "pod"),
    "node": ("reference", "node"),
    "event": ("reference", "event"),
    "endpointslice": ("reference", "endpointslice"),
    "service_topology": ("reference", "service"),
    **dict.fromkeys(("reference", "generic", "secret_metadata", "workload", "gitops", "webhook", "rbac", "certmanager", "crd"), ("reference",)),
    "none": (),
}


#: Extractors and the kind that each is for ('' for all).
EXTRACTORS = {"reference": "", "pod": "Pod", "node": "Node", "event": "Event", "endpointslice": "EndpointSlice", "service": "Service"}
#: Names a document's items and what is read of them: the columns that with_items() adds.
ADDED = ("items", "fingerprint", "extractors")
_LABEL = "metadata.labels.kubernetes~.io/service-name"
_STATUSES = ("initContainerStatuses", "containerStatuses", "ephemeralContainerStatuses")
_INGRESS = "status.loadBalancer.ingress[*]"
_CONDITIONS = "status.conditions[*]"
_REFERENCE_PARTS = ("group", "apiGroup", "apiVersion", "kind", "namespace", "name")
_QUANTITIES = [(part, resource) for part in ("capacity", "allocatable") for resource in ("cpu", "memory", "pods", "ephemeral-storage")]


def _joined(*parts: str) -> str:
    return ".".join(p for p in parts if p)


def _parted(path: str) -> tuple[str, str]:
    """A rule's path as the list whose items it is about ('' is the document itself) and the member in such an item."""
    head, mark, rest = path.rpartition("[*]")
    return head + mark, rest.removeprefix(".")


def _edge_rules() -> list[tuple]:
    """(extractor, kind or '' for all, list, member, name_member, edge, group, dst_kind, space, refers, cluster_wide) of each edge that a document may have.

    space is where the target is: own (the object's namespace), none, named (the one that the item names), either (named, else own), subject.
    refers: the item itself may name group and kind.
    """
    rules: list[tuple] = []
    for t in TARGETS:
        at, member = _parted(t.path)
        extractor = "pod" if t.edge == "pod_on_node" else "reference"
        rules += [(extractor, kind, at, member, _joined(member, t.name_key), t.edge, t.group, t.kind, "own" if t.own else "none", False, "") for kind in t.kinds]
    for r in REFERENCES:
        at, member = _parted(r.path)
        extractor = "event" if r.kinds == ("Event",) else "reference"
        rules += [(extractor, kind, at, member, _joined(member, "name"), r.edge, r.group, r.kind, "either", True, " ".join(r.cluster_wide)) for kind in r.kinds or ("",)]
    for kinds, path, edge, _ in SERVICES:
        at, member = _parted(path)
        rules += [("reference", kind, at, member, _joined(member, "name"), edge, "", "Service", "named", False, "") for kind in kinds]
    rules += [("reference", kind, "subjects[*]", "", "name", "rbac_binding_binds_subject", "", "", "subject", True, "") for kind in ("RoleBinding", "ClusterRoleBinding")]
    rules.append(("endpointslice", "EndpointSlice", "", "", _LABEL, "endpointslice_for_service", "", "Service", "own", False, ""))
    rules.append(("endpointslice", "EndpointSlice", "endpoints[*]", "targetRef", "targetRef.name", "endpointslice_targets_pod", "", "Pod", "either", False, ""))
    return rules


_RULE = ("extractor", "rule_kind", "rule_list", "member", "name_member", "edge_type", "group", "dst_kind", "space", "refers", "cluster_wide")
EDGE_RULES = _edge_rules()


@lru_cache(1024)
def wanted(kind: str) -> dict[str, set[str]]:
    """What is read of documents of a kind: the members of the document ('') and of the items of each list. Lists that only lead to others are there too."""
    read: dict[str, set[str]] = {"": {"roleRef.name", "roleRef.kind", "spec.clusterIP", "message", "note", "count", "series.count", *(f"status.{p}.{r}" for p, r in _QUANTITIES)}}
    more = {
        _CONDITIONS: ("type", "status", "reason"), "webhooks[*]": ("name", "failurePolicy"), "subjects[*]": ("kind", "name", "namespace"), _INGRESS: ("ip", "hostname", "ipMode"),
        "endpoints[*]": ("targetRef.kind", "targetRef.namespace", "conditions.ready", "conditions.serving", "conditions.terminating"),
        **{f"status.{s}[*]": ("name", "restartCount", *(f"{a}.{b}.reason" for a in ("state", "lastState") for b in ("waiting", "terminated"))) for s in _STATUSES},
    }
    hooks, bindings = kind.endswith("WebhookConfiguration"), kind in ("RoleBinding", "ClusterRoleBinding")
    needed = {"webhooks[*]": hooks, "subjects[*]": bindings, _INGRESS: kind == "Service", "endpoints[*]": kind == "EndpointSlice", _CONDITIONS: True}
    for at, members in more.items():
        if needed.get(at, kind == "Pod"):
            read.setdefault(at, set()).update(members)
    for _, kinds, path, _, _ in FACTS:
        if kind in kinds:
            at, member = _parted(path)
            read.setdefault(at, set()).add(member)
    for rule in EDGE_RULES:
        if rule[1] not in ("", kind):
            continue
        at, member, name_member, refers = rule[2], rule[3], rule[4], rule[9]
        read.setdefault(at, set()).update({member, name_member, _joined(member, "namespace")}, {_joined(member, p) for p in _REFERENCE_PARTS} if refers else ())
    for at in list(read):
        while at:
            at = _parted(at.removesuffix("[*]"))[0]
            read.setdefault(at, set())
    return read


class _Node:
    """A member that is read, or leads to one: its path in the item, whether its scalar is read, the path of its list's items, and its own members by key."""

    __slots__ = ("at", "below", "items", "read")

    def __init__(self, at: str, items: str | None) -> None:
        self.at, self.items, self.read, self.below = at, items, False, {}


@lru_cache(1024)
def _tree(kind: str) -> dict[str, _Node]:
    """wanted() as a tree of keys for the items of each list, so that what no rule reads isn't walked."""
    read = wanted(kind)
    node_of = lambda path, at: _Node(at, below if (below := f"{_joined(path, at)}[*]") in read else None)
    roots = {path: node_of(path, "") for path in read}
    lists = [(path, at, False) for below in read if below for path, at in [_parted(below.removesuffix("[*]"))]]
    for path, at, scalar in lists + [(path, at, True) for path, members in read.items() for at in members]:
        node = roots[path]
        key = ""
        for step in re.split(r"(?<!~)\.", at) if at else ():
            key = _joined(key, step)
            node = node.below.setdefault(step.replace("~.", ".").replace("~[", "["), node_of(path, key))
        node.read = node.read or scalar
    return roots


#: Documents whose items a worker holds as Python objects at one time.
DOCS = 500
_ITEM = "array<struct<path:string,strings:map<string,string>,numbers:map<string,double>,flags:map<string,boolean>>>"


def items_of(doc: str | None, kind: str) -> list[dict]:
    """The items of a document that are read of its kind, the document itself first: scalar members by dotted path (dots and brackets of keys have a ~ before
    them), and a flag for each wanted list. None where it isn't a JSON object."""
    try:
        root = json.loads(doc)
    except (TypeError, ValueError, RecursionError):
        return []
    if not isinstance(root, dict):
        return []
    read, items, open_items = _tree(kind), [], [("", root)]
    for path, item in open_items:  # grows
        strings, numbers, flags = {}, {}, {}
        members = [(read[path], item)]
        while members:
            node, x = members.pop()
            if isinstance(x, dict):
                members += [(below, x[k]) for k, below in node.below.items() if k in x]
            elif isinstance(x, list):
                if node.items is not None:
                    flags[f"{node.at}[*]"] = True
                    open_items += [(node.items, y) for y in x if y is not None]
            elif node.read:
                if isinstance(x, str):
                    strings[node.at] = x
                elif isinstance(x, bool):
                    flags[node.at] = x
                elif x is not None and abs(x) < 1e308:
                    numbers[node.at] = float(x)
        items.append({"path": path, "strings": strings, "numbers": numbers, "flags": flags})
    return items


def _items_array(docs: list[str | None], kinds: list[str]) -> pa.Array:
    """items_of() of each document, laid flat: Arrow takes several times as long to find the members of nested Python objects by itself."""
    ends, paths = [0], []
    parts = {name: ([0], [], []) for name in ("strings", "numbers", "flags")}
    for doc, kind in zip(docs, kinds, strict=True):
        for item in items_of(doc, kind):
            paths.append(item["path"])
            for name, (member_ends, keys, values) in parts.items():
                if of := item[name]:
                    keys += of.keys()
                    values += of.values()
                member_ends.append(len(keys))
        ends.append(len(paths))
    whole = lambda x: pa.array(x, pa.int32())
    columns = [pa.array(paths, pa.string())]
    for (member_ends, keys, values), of in zip(parts.values(), (pa.string(), pa.float64(), pa.bool_()), strict=True):
        columns.append(pa.MapArray.from_arrays(whole(member_ends), pa.array(keys, pa.string()), pa.array(values, of)))
    return pa.ListArray.from_arrays(whole(ends), pa.StructArray.from_arrays(columns, ["path", *parts]))


def unreadable(observations: DataFrame) -> DataFrame:
    """Rows whose document isn't a JSON object, which give no evidence: (cluster_id, resource, rows)."""
    bad = F.col("doc").isNull() | F.expr("try_parse_json(doc) IS NULL OR NOT startswith(schema_of_variant(try_parse_json(doc)), 'OBJECT')")
    return observations.where(bad).groupBy("cluster_id", "resource").agg(F.count("*").alias("rows"))


def _known(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _first(*values: Column) -> Column:
    """The first value that is there and not empty, else ''."""
    return F.coalesce(*(F.when(v != "", v) for v in values), F.lit(""))


def _at(kind: str, member: str | Column) -> Column:
    """A member of the item: kind is strings, numbers or flags."""
    return F.try_element_at(F.col(f"item.{kind}"), F.lit(member) if isinstance(member, str) else member)


def _string(member: str | Column) -> Column:
    return _known(_at("strings", member))


def with_items(observations: DataFrame, extractor_set: str | Column = "default", wanted: Column | None = None) -> DataFrame:
    """observations with the items of their documents, the fingerprint of an event's message, and the names of the extractors that apply; rows that
    aren't wanted have no items and aren't parsed. An unknown extractor set has no extractors."""
    named = F.lit(extractor_set) if isinstance(extractor_set, str) else extractor_set
    doc = F.col("doc") if wanted is None else F.when(wanted, F.col("doc"))

    @F.arrow_udf(_ITEM)
    def run(docs: pa.Array, kinds: pa.Array) -> pa.Array:
        parts = ((docs.slice(i, DOCS), kinds.slice(i, DOCS)) for i in range(0, max(len(docs), 1), DOCS))
        return pa.concat_arrays([_items_array(a.to_pylist(), b.to_pylist()) for a, b in parts])

    # so that Spark doesn't parse a second time in a filter on the number of items that it adds before their explode
    run = run.asNondeterministic()
    sets = F.create_map(*(x for name, of in SETS.items() for x in (F.lit(name), F.array(*map(F.lit, of)).cast("array<string>"))))
    d = observations.withColumn("items", run(doc, _known(F.col("kind")))).withColumn("extractors", F.coalesce(F.try_element_at(sets, named), F.array().cast("array<string>")))
    root = F.get("items", 0)["strings"]
    message = F.when(F.col("kind") == "Event", _first(F.try_element_at(root, F.lit("message")), F.try_element_at(root, F.lit("note"))))
    return d.withColumn("fingerprint", fnv1a64(F.when(message != "", message)))


def _item_rows(out: DataFrame) -> DataFrame:
    """A row an item, with what is read of the document beside it: the status of its first Ready condition, the service of its label, the number of its ingress points."""
    root, numbers = F.get("items", 0)["strings"], F.get("items", 0)["numbers"]
    measured = lambda key: F.coalesce(F.try_element_at(numbers, F.concat(F.lit("status."), key)), quantity_to_double(F.try_element_at(root, F.concat(F.lit("status."), key))))
    keys = F.array(*(F.lit(f"{part}.{resource}") for part, resource in _QUANTITIES))
    quantities = F.when(F.col("kind") == "Node", F.map_from_arrays(keys, F.transform(keys, measured)))
    ready = F.get(F.filter("items", lambda x: (x["path"] == _CONDITIONS) & (F.try_element_at(x["strings"], F.lit("type")) == "Ready")), 0)["strings"]
    by = (F.array_contains("extractors", name) & ((F.col("kind") == kind) if kind else F.lit(True)) for name, kind in EXTRACTORS.items())
    read = out.select(
        "cluster_id", "observed_at", "object_id", _known(F.col("kind")).alias("kind"), _known(F.col("namespace")).alias("namespace"), "name", "observation_type", "extractors", "fingerprint", "items",
        *(b.alias(f"by_{name}") for b, name in zip(by, EXTRACTORS, strict=True)), _known(F.try_element_at(ready, F.lit("status"))).alias("ready"), _known(F.try_element_at(root, F.lit(_LABEL))).alias("service"),
        _known(F.try_element_at(root, F.lit("spec.type"))).alias("service_type"), F.size(F.filter("items", lambda x: x["path"] == _INGRESS)).alias("n_ingress"), quantities.alias("quantities"),
    )
    return read.select("*", F.explode("items").alias("item")).drop("items").withColumn("list", F.col("item.path"))


#: The namespace of a binding's subject: none for persons, else its own, else for a service account that of the binding.
_SUBJECT_SPACE = """CASE WHEN try_element_at(item.strings, 'kind') IN ('User', 'Group') THEN ''
    ELSE coalesce(nullif(try_element_at(item.strings, 'namespace'), ''), if(try_element_at(item.strings, 'kind') = 'ServiceAccount', namespace, '')) END"""


class _Found:
    """Gathers facts and changes as SQL expressions over a row of _item_rows(): each a structure, or null where its condition doesn't hold. They are
    text, as building some hundred of them call by call takes seconds of the driver."""

    def __init__(self) -> None:
        self.facts: list[str] = []
        self.changes: list[str] = []

    def fact(self, when: str, key: str, value: str, severity: str | int, number: str = "CAST(NULL AS DOUBLE)", detail: str = "''") -> None:
        row = {"fact_key": key, "fact_value": value, "numeric_value": number, "severity": severity, "detail": detail}
        self.facts.append(_struct(when, row))

    def change(self, when: str, family: str, path: str, value: str, severity: str | int, op: str = "replace") -> None:
        row = {"change_family": _q(family), "path": path, "op": _q(op), "old_scalar": "''", "new_scalar": value, "severity": severity}
        self.changes.append(_struct(when, row))

    def both(self, when: str, key: str, family: str, path: str, value: str, severity: str | int, number: str = "CAST(NULL AS DOUBLE)", op: str = "replace") -> None:
        self.fact(when, key, value, severity, number)
        self.change(when, family, path, value, severity, op)


def _q(text: str) -> str:
    return f"'{text}'"


def _struct(when: str, row: dict[str, str | int]) -> str:
    return f"CASE WHEN {when} THEN named_struct({', '.join(f'{_q(c)}, {v}' for c, v in row.items())}) END"


def _text(member: str) -> str:
    """A string member of the item, '' where it has none."""
    return f"coalesce(try_element_at(item.strings, '{member}'), '')"


def _number(member: str) -> str:
    return f"try_element_at(item.numbers, '{member}')"


def _either(*values: str) -> str:
    """The first value that isn't empty, else ''."""
    return f"coalesce({', '.join(f'nullif({v}, {_q("")})' for v in values)}, '')"


def _plain_text(n: str) -> str:
    return f"CASE WHEN {n} = floor({n}) AND abs({n}) < 1e18 THEN CAST(CAST({n} AS DECIMAL(20, 0)) AS STRING) ELSE CAST({n} AS STRING) END"


def _in(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(map(_q, values))})"


def _found() -> _Found:
    f = _Found()
    of = lambda at: f"list = '{at}'"
    name, status, type_of, reason = (_text(m) for m in ("name", "status", "type", "reason"))
    for extractor, kinds, path, key, severity in FACTS:
        at, member = _parted(path)
        f.fact(f"{of(at)} AND by_{extractor} AND {_in('kind', kinds)} AND {_text(member)} <> ''", _q(key), _text(member), severity)
    # references
    for kinds, path, _, key in SERVICES:
        at, member = _parted(path)
        service, space = _text(_joined(member, "name")), _text(_joined(member, "namespace"))
        f.both(f"{of(at)} AND by_reference AND {_in('kind', kinds)} AND {service} <> ''", _q(key), "reference", _q(key), f"concat_ws('/', nullif({space}, ''), {service})", 50)
    policy = _text("failurePolicy")
    path = f"concat_ws('.', 'webhooks', nullif({name}, ''), 'failurePolicy')"
    f.both(f"{of('webhooks[*]')} AND by_reference AND endswith(kind, 'WebhookConfiguration') AND {policy} <> ''", _q("admission_webhook.failure_policy"), "admission_webhook", path, policy, f"if({policy} = 'Fail', 70, 40)")
    role, binds = _text("roleRef.name"), "by_reference AND kind IN ('RoleBinding', 'ClusterRoleBinding')"
    f.both(f"list = '' AND {binds} AND {role} <> ''", _q("rbac.role_ref"), "rbac", _q("roleRef"), f"concat_ws('/', {_either(_text('roleRef.kind'), _q('Role'))}, {role})", 50)
    whom = _text("kind")
    f.fact(f"{of('subjects[*]')} AND {binds} AND {whom} <> '' AND {name} <> ''", _q("rbac.subject"), f"concat_ws('/', {whom}, nullif({_SUBJECT_SPACE}, ''), {name})", 40)
    condition = f"{of(_CONDITIONS)} AND {type_of} <> '' AND {status} <> ''"
    path, severity = f"concat('status.conditions.', {type_of})", f"if({status} IN ('False', 'Unknown'), 60, 20)"
    f.both(f"{condition} AND by_reference", f"concat('status_condition.', {type_of})", "status", path, status, severity)
    f.fact(f"{condition} AND by_reference AND {reason} <> ''", f"concat('status_condition.', {type_of}, '.reason')", reason, severity)
    # pods
    f.both("list = '' AND by_pod AND ready <> ''", _q("pod_status.ready"), "status", _q("status.conditions.Ready"), "ready", "if(ready = 'False', 50, 20)")
    container = f"{_in('list', tuple(f'status.{s}[*]' for s in _STATUSES))} AND by_pod"
    place, n = f"concat('status.containerStatuses.', {name}, ", _number("restartCount")
    f.fact(f"{container} AND {n} IS NOT NULL", _q("pod_status.restart_count"), _plain_text(n), 30, n)
    f.change(f"{container} AND {n} > 0", "status", f"{place}'.restartCount')", _plain_text(n), 50)
    for state, key in (("state", "reason"), ("lastState", "last_reason")):
        why = _either(_text(f"{state}.waiting.reason"), _text(f"{state}.terminated.reason"))
        f.both(f"{container} AND {why} <> ''", _q(f"pod_status.{key}"), "status", f"{place}'.{state}.reason')", why, f"if({_in(why, SEVERE)}, 90, 50)")
    for extractor, key in (("pod", "pod_placement.deleted"), ("service", "service.deleted")):
        f.both(f"list = '' AND by_{extractor} AND observation_type = 'DELETED'", _q(key), "status", _q("metadata.deletionTimestamp"), "'true'", 60, op="delete")
        f.changes[-1] = f.changes[-1].replace("'true'", "'deleted'")
    # nodes
    for part, resource in _QUANTITIES:
        number, written = _number(f"status.{part}.{resource}"), f"try_element_at(item.strings, 'status.{part}.{resource}')"
        value = f"coalesce({written}, {_plain_text(number)})"
        f.fact(f"list = '' AND by_node AND {value} IS NOT NULL", _q(f"node_{part}.{resource.replace('-', '_')}"), value, 10, f"try_element_at(quantities, '{part}.{resource}')")
    severity = f"if({type_of} <> 'Ready' AND {status} = 'True', 80, 20)"
    f.both(f"{condition} AND by_node", f"concat('node_condition.', {type_of})", "status", path, status, severity)
    # events
    message = _either(_text("message"), _text("note"))
    f.fact(f"list = '' AND by_event AND {message} <> ''", _q("k8s_event.message_fingerprint"), "fingerprint", 20)
    f.fact(f"list = '' AND by_event AND {message} <> ''", _q("k8s_event.message_preview"), f"substring({message}, 1, 512)", 20)
    for member, key in (("count", "k8s_event.count"), ("series.count", "k8s_event.series_count")):
        n = _number(member)
        f.both(f"list = '' AND by_event AND {n} IS NOT NULL", _q(key), "event_rollup", _q(member), _plain_text(n), 20, n)
    # Endpoint slices
    point, pod = f"{of('endpoints[*]')} AND by_endpointslice", f"if(service <> '' AND {_text('targetRef.kind')} = 'Pod', {_text('targetRef.name')}, '')"
    f.change(f"{point} AND {pod} <> ''", "topology", _q("endpoints.targetRef"), f"concat('Pod/', {pod})", 30, "add")
    for key in ("ready", "serving", "terminating"):
        flag = f"try_element_at(item.flags, 'conditions.{key}')"
        f.both(f"{point} AND {flag} IS NOT NULL", _q(f"endpoint.{key}"), "status", f"concat_ws('.', 'endpoints', nullif({pod}, ''), 'conditions.{key}')", f"CAST({flag} AS STRING)", 20)
    # E5: services
    f.change("list = '' AND by_service AND service_type <> ''", "spec", _q("spec.type"), "service_type", 10)
    f.fact(f"list = '' AND by_service AND {_text('spec.clusterIP')} NOT IN ('', 'None')", _q("service.cluster_ip"), _text("spec.clusterIP"), 10)
    balanced = "list = '' AND by_service AND service_type = 'LoadBalancer'"
    f.fact(balanced, _q("service.load_balancer.ingress_count"), "CAST(n_ingress AS STRING)", 10, "CAST(n_ingress AS DOUBLE)")
    f.fact(balanced, _q("service.load_balancer.pending"), "CAST(n_ingress = 0 AS STRING)", "if(n_ingress = 0, 50, 10)")
    f.change(f"{balanced} AND n_ingress = 0", "status", _q("status.loadBalancer.ingress"), "'pending'", 50)
    mode = _text("ipMode")
    for key in ("ip", "hostname"):
        there = f"{of(_INGRESS)} AND by_service AND service_type = 'LoadBalancer' AND {_text(key)} <> ''"
        f.fact(there, _q(f"service.load_balancer.ingress_{key}"), _text(key), 10, detail=f"if({mode} <> '', to_json(named_struct('ipMode', {mode})), '')")
        f.change(there, "status", _q(f"status.loadBalancer.ingress.{key}"), _text(key), 10)
    return f


def _edge_rows(rows: DataFrame, resolver: Resolver) -> DataFrame:
    """Edges: items met by their rules, then by the resource table, both small and broadcast."""
    spark = rows.sparkSession
    columns = list(zip(*EDGE_RULES, strict=True))
    rules = spark.createDataFrame(pa.table(dict(zip(_RULE, map(list, columns), strict=True))))
    d = rows.join(F.broadcast(rules), (F.col("list") == F.col("rule_list")) & F.col("rule_kind").isin("", F.col("kind")) & F.array_contains("extractors", F.col("extractor")))
    part = lambda p: _string(F.concat_ws(".", F.when(F.col("member") != "", F.col("member")), F.lit(p)))
    subject, refers = F.col("space") == "subject", F.col("refers")
    name = F.coalesce(F.when(F.col("space").isin("own", "none"), _at("strings", F.col("member"))), _string(F.col("name_member")))
    to_kind = F.when(refers, _first(part("kind"), F.col("dst_kind"))).otherwise(F.col("dst_kind"))
    group = F.when(subject, F.when(part("kind").isin("User", "Group"), "rbac.authorization.k8s.io").otherwise(""))
    group = group.when(refers, _first(part("group"), part("apiGroup"), F.regexp_extract(part("apiVersion"), "^(.*)/", 1), F.col("group"))).otherwise(F.col("group"))
    space = F.when(subject, F.expr(_SUBJECT_SPACE)).when(F.col("space") == "own", F.col("namespace")).when(F.col("space") == "named", part("namespace"))
    space = space.when(F.col("space") == "either", F.when(F.array_contains(F.split("cluster_wide", " "), to_kind), "").otherwise(_first(part("namespace"), F.col("namespace")))).otherwise("")
    holds = F.when(F.col("edge_type") == "endpointslice_for_service", _at("flags", "endpoints[*]")).when(F.col("edge_type") == "endpointslice_targets_pod", (F.col("service") != "") & (part("kind") == "Pod")).otherwise(True)
    d = d.where(holds).select("cluster_id", "observed_at", "object_id", "kind", "edge_type", name.alias("to_name"), to_kind.alias("dst_kind"), group.alias("to_group"), space.alias("to_space"))
    d = d.where("to_name <> '' AND dst_kind <> ''")
    known = resolver.lookup()
    resources = spark.createDataFrame(pa.table({c: [r[i] for r in known] for i, c in enumerate(("asked", "of_kind", "r_group", "resource", "namespaced"))}))
    resources = F.broadcast(resources) if len(known) <= MOST_KINDS else resources
    d = d.join(resources, (F.col("to_group") == F.col("asked")) & (F.col("dst_kind") == F.col("of_kind")), "left")
    parts = [F.col("cluster_id"), F.coalesce("r_group", "to_group"), F.coalesce("resource", plural_of(F.col("dst_kind"))), F.when(F.coalesce("namespaced", F.lit(True)), F.col("to_space")), F.col("to_name")]
    dst = F.concat_ws("/", *(F.when(p != "", p) for p in parts))
    ends = [F.lit(None).cast("timestamp").alias("valid_to"), F.lit("").alias("detail")]
    return d.select("cluster_id", "edge_type", F.col("object_id").alias("src_id"), dst.alias("dst_id"), F.col("kind").alias("src_kind"), "dst_kind", F.col("observed_at").alias("valid_from"), *ends)


def split_evidence(out: DataFrame, resolver: Resolver | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, edges, changes) DataFrames of rows with items. Edges never close."""
    rows, found = _item_rows(out), _found()
    obj = ["cluster_id", F.col("observed_at").alias("ts"), "object_id", "kind", "namespace", "name"]
    facts, changes = (rows.select(*obj, F.explode(F.array_compact(F.expr(f"array({', '.join(of)})"))).alias("x")).select("cluster_id", "ts", "object_id", "kind", "namespace", "name", "x.*") for of in (found.facts, found.changes))
    return facts, _edge_rows(rows, resolver or Resolver()), changes


def evidence(observations: DataFrame, resolver: Resolver | None = None, extractor_set: str | Column = "default") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, edges, changes) DataFrames of observation rows that have an object_id. extractor_set: a set's name, or a column of names; an unknown set matches nothing."""
    return split_evidence(with_items(observations, extractor_set), resolver)

"""The filter chain: row transforms of documents, with an audit trail.

A chain is a list of Filter values; apply_chain() runs it in one Arrow-batched pass, which parses each document once. It adds
outcome (keep, keep_modified, discard_change, discard_resource) and decisions, an array of (filter, outcome, reason, meta).
A chain stops at its first discard.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.documents import dump, pointer_parts, remove_path
from ..functions.scalars import glob_to_regex

KEEP, MODIFIED, DISCARD_CHANGE, DISCARD_RESOURCE = "keep", "keep_modified", "discard_change", "discard_resource"
Step = Callable[[dict, dict], tuple[str, str, dict]]
_REF = ("api_group", "api_version", "resource", "kind", "namespace", "name")


@dataclass(frozen=True)
class Filter:
    """name, the step on (document, reference) giving (outcome, reason, meta), and an optional scope."""

    name: str
    step: Step
    scope: dict[str, list[str]] = field(default_factory=dict)

    def __call__(self, doc: dict, ref: dict) -> tuple[str, str, dict]:
        if self.scope and not in_scope(self.scope, ref):
            return KEEP, "scope_mismatch", {}
        return self.step(doc, ref)


def resource_names(ref: dict) -> list[str]:
    """The names by which a resource rule may mean it."""
    group, version, resource = ref["api_group"], ref["api_version"], ref["resource"]
    return [resource, f"{resource}.{group}" if group else resource, f"{group}/{version}/{resource}" if group else f"{version}/{resource}"]


def any_glob(patterns: list[str], values: list[str]) -> bool:
    return any(re.match(glob_to_regex(p.lower()), v.lower()) for p in patterns for v in values)


def in_scope(scope: dict[str, list[str]], ref: dict) -> bool:
    """namespaces AND names AND (kinds OR resources); an empty list asks for nothing."""
    for key in ("namespace", "name"):
        wanted = scope.get(f"{key}s")
        if wanted and not any_glob(wanted, [ref[key]]):
            return False
    kinds, resources = scope.get("kinds"), scope.get("resources")
    return not (kinds or resources) or bool(kinds and any_glob(kinds, [ref["kind"]])) or bool(resources and any_glob(resources, resource_names(ref)))


def remove_paths(name: str, pointers: list[str], reason: str = "paths_removed", **scope: list[str]) -> Filter:
    """map members at JSON pointers."""
    parts = [pointer_parts(p) for p in pointers]

    def step(doc: dict, ref: dict) -> tuple[str, str, dict]:
        n = sum(remove_path(doc, p) for p in parts)
        return (MODIFIED, reason, {"removed": n}) if n else (KEEP, "", {})

    return Filter(name, step, scope)


def secret_payload(name: str = "secret_metadata_only") -> Filter:
    """the payload of secrets."""

    def step(doc: dict, ref: dict) -> tuple[str, str, dict]:
        parts = {k: doc.pop(k) for k in ("data", "stringData") if k in doc}
        gone = {k: len(x) if isinstance(x, dict) else 0 for k, x in parts.items()}
        return (MODIFIED, "secret_payload_removed", {f"{k}_keys": n for k, n in gone.items()}) if gone else (KEEP, "", {})

    return Filter(name, step, {"resources": ["secrets"]})


def condition_set(name: str = "status_condition_set") -> Filter:
    """conditions without times, in a stable order of their types."""
    times = ("lastHeartbeatTime", "lastTransitionTime", "lastUpdateTime")

    def step(doc: dict, ref: dict) -> tuple[str, str, dict]:
        status = doc.get("status")
        items = status.get("conditions") if isinstance(status, dict) else None
        if not isinstance(items, list):
            return KEEP, "", {}
        after = [{k: v for k, v in c.items() if k not in times} if isinstance(c, dict) else c for c in items]
        after.sort(key=lambda c: str(c.get("type", "")) if isinstance(c, dict) else "")
        if after == items:
            return KEEP, "", {}
        status["conditions"] = after
        return MODIFIED, "status_conditions_normalized", {"conditions": len(after)}

    return Filter(name, step)


def leader_annotation(name: str = "leader_election_configmap") -> Filter:
    """the leader-election annotation, and the annotations map if nothing else is in it."""
    key = "control-plane.alpha.kubernetes.io/leader"

    def step(doc: dict, ref: dict) -> tuple[str, str, dict]:
        found = (doc.get("metadata") or {}).get("annotations")
        if not isinstance(found, dict) or key not in found:
            return KEEP, "", {}
        del found[key]
        if not found:
            del doc["metadata"]["annotations"]
        return MODIFIED, "leader_election_annotation_removed", {}

    return Filter(name, step, {"resources": ["configmaps"]})


def autoscaler_status(name: str = "cluster_autoscaler_status") -> Filter:
    """F8: the YAML status of the cluster autoscaler without times, node groups by name."""

    def clean(node: Any) -> Any:
        if isinstance(node, dict):
            return {k: sorted(map(clean, v), key=lambda g: str(g.get("name", "")) if isinstance(g, dict) else "") if k == "nodeGroups" and isinstance(v, list) else clean(v) for k, v in node.items() if k not in ("time", "lastProbeTime", "lastTransitionTime")}
        return [clean(x) for x in node] if isinstance(node, list) else node

    def step(doc: dict, ref: dict) -> tuple[str, str, dict]:
        import yaml

        data = doc.get("data")
        try:
            node = yaml.safe_load(data["status"])
        except (KeyError, TypeError, yaml.YAMLError):
            return KEEP, "", {}
        if not isinstance(node, dict):
            return KEEP, "", {}
        after = yaml.safe_dump(clean(node), sort_keys=True)
        if after == data["status"]:
            return KEEP, "", {}
        data["status"] = after
        return MODIFIED, "cluster_autoscaler_status_normalized", {}

    return Filter(name, step, {"resources": ["configmaps"], "namespaces": ["kube-system"], "names": ["cluster-autoscaler-status"]})


def webhook_heartbeat(name: str = "gke_webhook_heartbeat") -> Filter:
    """heartbeat values become 'hostname: version'."""

    def step(doc: dict, ref: dict) -> tuple[str, str, dict]:
        data, n = doc.get("data"), 0
        for key, value in (data or {}).items() if isinstance(data, dict) else ():
            try:
                beat = json.loads(value)
            except (TypeError, ValueError):
                continue
            if isinstance(beat, dict) and beat.get("hostname"):
                data[key] = f"{beat['hostname']}: {beat.get('version', '')}"
                n += 1
        return (MODIFIED, "webhook_heartbeat_normalized", {"entries": n}) if n else (KEEP, "", {})

    return Filter(name, step, {"resources": ["configmaps"], "namespaces": ["kube-system"], "names": ["gke-common-webhook-heartbeat"]})


def static(name: str, outcome: str, reason: str = "", **scope: list[str]) -> Filter:
    """a fixed outcome."""
    return Filter(name, lambda doc, ref: (outcome, reason or name, {}), scope)


def default_chains() -> dict[str, list[Filter]]:
    managed = remove_paths("managed_fields", ["/metadata/managedFields"])
    version = remove_paths("resource_version", ["/metadata/resourceVersion"])
    generation = remove_paths("metadata_generation", ["/metadata/generation"])
    series = remove_paths("event_series", [f"/{p}" for p in ("deprecatedCount", "deprecatedLastTimestamp", "series", "eventTime")], resources=["events.events.k8s.io"])
    return {
        "default": [managed, version, generation, condition_set(), leader_annotation(), autoscaler_status(), webhook_heartbeat()],
        "event_rollup": [managed, version, series],
        "secret_metadata_only": [managed, version, secret_payload()],
        "lease_skip": [static("lease_skip", DISCARD_RESOURCE, resources=["leases.coordination.k8s.io"])],
        "report_skip": [static("report_skip", DISCARD_RESOURCE)],
        "none": [],
    }


_OUT = "doc string, outcome string, decisions array<struct<filter:string,outcome:string,reason:string,meta:string>>"


def _run(text: str, ref: dict, chain: list[Filter]) -> tuple[str, str, list[dict]]:
    try:
        doc = json.loads(text)
    except (TypeError, ValueError):
        doc = None
    if not isinstance(doc, dict):  # nothing to filter; what may be a payload isn't kept
        if ref["resource"] == "secrets" and text:
            return "", MODIFIED, [{"filter": "secret_metadata_only", "outcome": MODIFIED, "reason": "secret_payload_removed", "meta": "{}"}]
        return text, KEEP, []
    last, decisions = KEEP, []
    for f in chain:
        try:
            outcome, reason, meta = f(doc, ref)
        except (AttributeError, KeyError, TypeError, ValueError):  # a part of the document isn't what the filter reads
            outcome, reason, meta = KEEP, "malformed", {}
        decisions.append({"filter": f.name, "outcome": outcome, "reason": reason, "meta": dump(meta)})
        if outcome != KEEP:
            last = outcome
        if outcome in (DISCARD_CHANGE, DISCARD_RESOURCE):
            break
    return dump(doc), last, decisions


def apply_chains(df: DataFrame, chains: dict[str, list[Filter]] | None = None, chain: Column | None = None) -> DataFrame:
    """df (reference columns and doc) with the filtered doc, outcome and decisions. chain names each row's chain; '' and unknown names mean the default."""
    chains = chains or default_chains()

    @F.pandas_udf(_OUT)
    def run(doc: pd.Series, name: pd.Series, ref: pd.DataFrame) -> pd.DataFrame:
        refs = ref.fillna("").to_dict("records")
        rows = [_run(d, r, chains.get(n or "default", chains["default"])) for d, n, r in zip(doc, name, refs, strict=True)]
        return pd.DataFrame(rows, columns=["doc", "outcome", "decisions"])

    out = df.withColumn("_f", run("doc", chain if chain is not None else F.lit("default"), F.struct(*_REF)))
    return out.withColumns({"doc": F.col("_f.doc"), "outcome": F.col("_f.outcome"), "decisions": F.col("_f.decisions")}).drop("_f")


def kept(filtered: DataFrame) -> DataFrame:
    """what goes on to storage. discard_change keeps deletions."""
    return filtered.where((F.col("outcome") != DISCARD_RESOURCE) & ((F.col("outcome") != DISCARD_CHANGE) | (F.col("observation_type") == "DELETED")))


def decision_rows(filtered: DataFrame) -> DataFrame:
    """One filter_decisions row for each decision that did something."""
    d = filtered.select("*", F.explode("decisions").alias("d")).where(F.col("d.outcome") != KEEP)
    destructive = F.col("d.outcome").isin(DISCARD_CHANGE, DISCARD_RESOURCE) | (F.col("d.reason") == "secret_payload_removed")
    return d.select(F.col("observed_at").alias("ts"), "cluster_id", *_REF, "uid", "resource_version", "observation_type", F.col("d.filter").alias("filter_name"), F.col("d.outcome").alias("outcome"), F.col("d.reason").alias("reason"), destructive.alias("destructive"), F.col("d.meta").alias("meta"))


#: Normalizers whose decisions are counted by the hour instead of kept.
ROLLED_UP = ("managed_fields", "resource_version", "metadata_generation", "status_condition_set")


def persisted_decisions(decisions: DataFrame, columnar: bool = False) -> tuple[DataFrame, DataFrame]:
    """(detail, hourly rollup): discards and secret removals in detail; the row policy also keeps unknown normalizers."""
    detail = F.col("destructive")
    if columnar:
        return decisions.where(detail), hourly_rollup(decisions.where(F.lit(False)))
    known = F.col("filter_name").isin(*ROLLED_UP)
    return decisions.where(detail | ~known), hourly_rollup(decisions.where(~detail & known))


def hourly_rollup(decisions: DataFrame) -> DataFrame:
    """Counts by hour, with first and last times; merge_rollups() adds two of them."""
    keys = ["cluster_id", "filter_name", "outcome", "reason"]
    return decisions.groupBy(F.date_trunc("hour", "ts").alias("hour"), *keys).agg(F.count("*").alias("decisions"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def merge_rollups(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = ["hour", "cluster_id", "filter_name", "outcome", "reason"]
    return a.unionByName(b).groupBy(*keys).agg(F.sum("decisions").alias("decisions"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


@F.pandas_udf(StringType())
def redact_secret(doc: pd.Series, resource: pd.Series) -> pd.Series:
    """values of secrets become <redacted>; keys stay."""

    def one(text: str, kind: str) -> str:
        if kind != "secrets" or not text:
            return text
        try:
            node = json.loads(text)
        except ValueError:
            return ""
        if not isinstance(node, dict):
            return ""
        for part in ("data", "stringData"):
            if isinstance(node.get(part), dict):
                node[part] = dict.fromkeys(node[part], "<redacted>")
        return dump(node)

    return pd.Series([one(d, r) for d, r in zip(doc, resource, strict=True)])


_ADDRESS = re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}\b")


def sanitize(df: DataFrame, salt: str = "") -> DataFrame:
    """names, addresses, images and messages of documents under aliases; equal values get equal aliases. A document that isn't JSON becomes empty, as
    what it holds can't be told."""

    def alias(kind: str, value: str) -> str:
        return f"{kind}-{hashlib.sha256(f'{salt}/{value}'.encode()).hexdigest()[:10]}"

    def clean(node: Any, key: str = "") -> Any:
        if isinstance(node, dict):
            return {k: clean(v, k) for k, v in node.items()}
        if isinstance(node, list):
            return [clean(x, key) for x in node]
        if not isinstance(node, str) or not node:
            return node
        if key in ("name", "namespace", "nodeName", "hostname", "claimName", "secretName", "serviceAccountName"):
            return alias("name", node)
        if key in ("image", "imageID", "message", "note"):
            return alias(key, node)
        return _ADDRESS.sub(lambda m: alias("ip", m[0]), node)

    def one(text: str) -> str:
        try:
            return dump(clean(json.loads(text)))
        except ValueError:
            return ""

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(one, na_action="ignore")

    return df.withColumn("doc", run("doc"))

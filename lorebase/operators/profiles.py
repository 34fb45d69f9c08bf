"""Resource profiles: which filter chain and which extractors an object's rows get, told by its group, resource and kind."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import glob_match

#: The default rules, in order; the first that matches counts. An empty list asks for nothing, "" is the core group.
RULES: list[dict[str, Any]] = [
    {"profile": "pod_fast_path", "groups": [""], "resources": ["pods"], "extractors": "pod"},
    {"profile": "node_summary", "groups": [""], "resources": ["nodes"], "extractors": "node"},
    {"profile": "event_rollup", "resources": ["events"], "kinds": ["event"], "chain": "event_rollup", "extractors": "event"},
    {"profile": "endpointslice_topology", "groups": ["discovery.k8s.io"], "resources": ["endpointslices"], "extractors": "endpointslice"},
    {"profile": "lease_skip_or_downsample", "enabled": False, "groups": ["coordination.k8s.io"], "resources": ["leases"], "chain": "lease_skip", "extractors": "none"},
    {"profile": "low_signal_report", "enabled": False, "groups": ["wgpolicyk8s.io"], "resources": ["policyreports", "clusterpolicyreports"], "chain": "report_skip", "extractors": "none"},
    {"profile": "low_signal_report", "enabled": False, "groups": ["reports.kyverno.io"], "resources": ["ephemeralreports", "clusterephemeralreports"], "chain": "report_skip", "extractors": "none"},
    {"profile": "secret_metadata_only", "groups": [""], "resources": ["secrets"], "chain": "secret_metadata_only", "extractors": "secret_metadata"},
    {"profile": "workload_rollout", "groups": ["apps"], "resources": ["deployments", "replicasets", "statefulsets", "daemonsets"], "extractors": "workload"},
    {"profile": "workload_rollout", "groups": ["batch"], "resources": ["jobs", "cronjobs"], "extractors": "workload"},
    {"profile": "service_topology", "groups": [""], "resources": ["services", "endpoints", "persistentvolumeclaims", "persistentvolumes"], "extractors": "service_topology"},
    {"profile": "service_topology", "groups": ["networking.k8s.io"], "resources": ["ingresses", "networkpolicies"], "extractors": "service_topology"},
    {
        "profile": "service_topology",
        "groups": ["gateway.networking.k8s.io"],
        "resources": ["gatewayclasses", "gateways", "httproutes", "grpcroutes", "tcproutes", "tlsroutes", "udproutes", "referencegrants"],
        "extractors": "service_topology",
    },
    {
        "profile": "admission_webhook",
        "groups": ["admissionregistration.k8s.io"],
        "resources": ["mutatingwebhookconfigurations", "validatingwebhookconfigurations", "validatingadmissionpolicies", "validatingadmissionpolicybindings"],
        "extractors": "webhook",
    },
    {
        "profile": "flux_gitops",
        "groups": ["source.toolkit.fluxcd.io", "kustomize.toolkit.fluxcd.io", "helm.toolkit.fluxcd.io", "image.toolkit.fluxcd.io", "notification.toolkit.fluxcd.io"],
        "extractors": "gitops",
    },
    {"profile": "argocd_gitops", "groups": ["argoproj.io"], "resources": ["applications", "appprojects", "applicationsets"], "extractors": "gitops"},
    {"profile": "rbac", "groups": ["rbac.authorization.k8s.io"], "resources": ["roles", "rolebindings", "clusterroles", "clusterrolebindings"], "extractors": "rbac"},
    {"profile": "certmanager", "groups": ["cert-manager.io", "acme.cert-manager.io"], "extractors": "certmanager"},
    {"profile": "crd_definition", "groups": ["apiextensions.k8s.io"], "resources": ["customresourcedefinitions"], "extractors": "crd"},
    {"profile": "prometheus_operator", "groups": ["monitoring.coreos.com"], "extractors": "generic"},
    {"profile": "victoriametrics_operator", "groups": ["operator.victoriametrics.com"], "extractors": "generic"},
    {"profile": "grafana_observability", "groups": ["monitoring.grafana.com"], "extractors": "generic"},
    {"profile": "kagent_ecosystem", "groups": ["kagent.dev"], "extractors": "generic"},
]
#: What an object that no rule matches gets.
DEFAULT = {"profile": "generic", "chain": "default", "extractors": "generic"}


def _matches(rule: dict[str, Any]) -> Column:
    ok = F.lit(True)
    for key, column in (("groups", "api_group"), ("resources", "resource"), ("kinds", "kind")):
        if wanted := rule.get(key):
            any_of = F.lit(False)
            for pattern in wanted:
                any_of = any_of | (glob_match(F.lower(column), pattern.lower()) if pattern else F.col(column) == "")
            ok = ok & any_of
    return ok


def with_profile(df: DataFrame, rules: list[dict[str, Any]] | None = None) -> DataFrame:
    """df (api_group, resource, kind) with profile, chain and extractor_set of the first enabled rule that matches; null columns count as ''."""
    chosen = F.struct(*(F.lit(DEFAULT[c]).alias(c) for c in DEFAULT))
    for rule in reversed(RULES if rules is None else rules):
        if rule.get("enabled", True):
            values = F.struct(*(F.lit(rule.get(c, DEFAULT[c])).alias(c) for c in DEFAULT))
            chosen = F.when(_matches(rule), values).otherwise(chosen)
    plain = df.fillna("", ["api_group", "resource", "kind"])
    return plain.withColumn("_p", chosen).withColumns({"profile": F.col("_p.profile"), "chain": F.col("_p.chain"), "extractor_set": F.col("_p.extractors")}).drop("_p")

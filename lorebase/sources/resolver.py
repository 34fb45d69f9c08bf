"""The API-resource dimension (E14): kinds to resources, seeded with built-ins and extended by discovery and CRDs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Resource(NamedTuple):
    group: str
    version: str
    resource: str
    kind: str
    namespaced: bool


#: Built-in resources, as group/version: kinds (a leading ~ marks cluster-wide ones).
BUILT_IN = {
    "/v1": "Pod Service ConfigMap Secret ServiceAccount Event Endpoints PersistentVolumeClaim ReplicationController LimitRange ResourceQuota PodTemplate ~Node ~Namespace ~PersistentVolume ~ComponentStatus",
    "apps/v1": "Deployment ReplicaSet DaemonSet StatefulSet ControllerRevision",
    "batch/v1": "Job CronJob",
    "autoscaling/v2": "HorizontalPodAutoscaler",
    "policy/v1": "PodDisruptionBudget",
    "discovery.k8s.io/v1": "EndpointSlice",
    "events.k8s.io/v1": "Event",
    "coordination.k8s.io/v1": "Lease",
    "networking.k8s.io/v1": "Ingress NetworkPolicy ~IngressClass",
    "rbac.authorization.k8s.io/v1": "Role RoleBinding ~ClusterRole ~ClusterRoleBinding ~User ~Group",
    "storage.k8s.io/v1": "~StorageClass ~CSIDriver ~CSINode ~VolumeAttachment",
    "apiextensions.k8s.io/v1": "~CustomResourceDefinition",
    "apiregistration.k8s.io/v1": "~APIService",
    "admissionregistration.k8s.io/v1": "~ValidatingWebhookConfiguration ~MutatingWebhookConfiguration",
    "scheduling.k8s.io/v1": "~PriorityClass",
    "gateway.networking.k8s.io/v1": "~GatewayClass Gateway HTTPRoute GRPCRoute",
    "cert-manager.io/v1": "Certificate CertificateRequest Issuer ~ClusterIssuer",
    "acme.cert-manager.io/v1": "Order Challenge",
}


def plural(kind: str) -> str:
    """The resource name that a kind has by rule."""
    k = kind.lower()
    if k.endswith("y") and k[-2:-1] not in "aeiou":
        return f"{k[:-1]}ies"
    if k.endswith("endpoints"):
        return k
    return f"{k}es" if k.endswith(("s", "x", "ch", "sh")) else f"{k}s"


def plural_of(kind: Column) -> Column:
    """plural() of a column."""
    k = F.lower(kind)
    by_rule = F.when(k.rlike("[^aeiou]y$"), F.regexp_replace(k, "y$", "ies")).when(k.endswith("endpoints"), k)
    return by_rule.when(k.rlike("(s|x|ch|sh)$"), F.concat(k, F.lit("es"))).otherwise(F.concat(k, F.lit("s")))


@dataclass
class Resolver:
    """Looks resources up by group and kind, or by kind alone where no group is given."""

    known: dict[tuple[str, str], Resource] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for where, kinds in BUILT_IN.items():
            group, version = where.split("/")
            for k in kinds.split():
                kind = k.removeprefix("~")
                self.known.setdefault((group, kind), Resource(group, version, plural(kind), kind, not k.startswith("~")))

    def add(self, *resources: Resource) -> Resolver:
        for r in resources:
            self.known[r.group, r.kind] = r
        return self

    def by_kind(self, group: str, kind: str) -> Resource:
        found = self.known.get((group, kind))
        if found is None and not group:
            found = next((r for (_, k), r in self.known.items() if k == kind), None)
        return found or Resource(group, "", plural(kind), kind, True)

    def lookup(self) -> list[tuple[str, str, str, str, bool]]:
        """(group asked for, kind, group, resource, namespaced) of all that by_kind() knows; what isn't here has its plural by rule."""
        asked = dict(self.known)
        for (_, kind), r in self.known.items():
            asked.setdefault(("", kind), r)
        return [(group, kind, r.group, r.resource, r.namespaced) for (group, kind), r in asked.items()]

    def with_crds(self, crd_docs: DataFrame) -> Resolver:
        """Adds the resources that custom resource definitions (column doc) define: a row a group and kind, the newest where observed_at is there.
        Definitions that aren't JSON, or have no kind, add nothing."""
        at = lambda path: F.coalesce(F.get_json_object("doc", f"$.spec.{path}"), F.lit(""))
        versions = F.coalesce(F.from_json(at("versions"), "array<struct<name:string,storage:boolean>>"), F.array())
        stored = F.coalesce(F.get(F.filter(versions, lambda v: v["storage"]), 0)["name"], F.get(versions, 0)["name"], F.lit(""))
        when = F.col("observed_at") if "observed_at" in crd_docs.columns else F.lit(0)
        rows = crd_docs.select(at("group").alias("group"), at("names.kind").alias("kind"), F.struct(when.alias("at"), stored.alias("version"), at("names.plural").alias("plural"), at("scope").alias("scope")).alias("d")).where("kind <> ''")
        for r in rows.groupBy("group", "kind").agg(F.max("d").alias("d")).collect():  # one row a kind that is defined
            d = r["d"]
            self.add(Resource(r["group"], d["version"], d["plural"] or plural(r["kind"]), r["kind"], d["scope"] != "Cluster"))
        return self

"""Recipes: DataFrame builders for questions users ask of evidence tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import moment, quantity_to_double
from ..operators.asof import newest_within
from ..operators.read import between
from ..sources.shared import dealt

REFS = ["cluster_id", "namespace", "name", "uid"]


def _at(doc: str, *path: str) -> Column:
    """A JSON value as text, '' where it is missing; keys may hold dots and slashes."""
    return F.coalesce(F.get_json_object(doc, "$" + "".join(f"['{p}']" for p in path)), F.lit(""))


def latest_docs(observations: DataFrame, kind: str, end: datetime | None = None, start: datetime | None = None) -> DataFrame:
    """Newest document of each object of a kind that isn't deleted, in a time window."""
    seen = between(observations.where(F.col("kind") == kind), "observed_at", start, end)
    last = F.struct("observed_at", "observation_type")
    return seen.groupBy(*REFS).agg(F.max_by("doc", last).alias("doc"), F.max_by("observation_type", last).alias("last_type"), F.max("observed_at").alias("last_seen")).where("last_type <> 'DELETED'")


def coverage_latest(observations: DataFrame) -> DataFrame:
    """Live objects and newest sighting by kind."""
    last = F.struct("observed_at", "observation_type")
    per = observations.groupBy("kind", *REFS).agg(F.max_by("observation_type", last).alias("t"), F.max("observed_at").alias("last_seen")).where("t <> 'DELETED'")
    return per.groupBy("cluster_id", "kind").agg(F.count("*").alias("objects"), F.max("last_seen").alias("last_seen"))


def fact_rollup(facts: DataFrame) -> DataFrame:
    """Facts by key and value: rows, objects, worst severity, last time."""
    return facts.groupBy("fact_key", "fact_value").agg(F.count("*").alias("rows"), F.countDistinct("object_id").alias("objects"), F.max("severity").alias("max_severity"), F.max("ts").alias("last_ts"))


def change_rollup(changes: DataFrame) -> DataFrame:
    """Changes by family and path."""
    return changes.groupBy("change_family", "path").agg(F.count("*").alias("rows"), F.countDistinct("object_id").alias("objects"), F.max("ts").alias("last_ts"))


def container_rows(observations: DataFrame, end: datetime | None = None) -> DataFrame:
    """T5: a row for each container of each live pod, with its requests as numbers."""
    pods = latest_docs(observations, "Pod", end)
    c = pods.select(*REFS, "last_seen", F.posexplode(F.from_json(_at("doc", "spec", "containers"), "array<struct<name:string,image:string,resources:struct<requests:map<string,string>,limits:map<string,string>>>>")).alias("i", "c"))
    req = lambda part, r: quantity_to_double(F.coalesce(F.col(f"c.resources.{part}")[r], F.lit("")))
    return c.select(*REFS, "last_seen", F.col("c.name").alias("container"), F.col("c.image").alias("image"), *(req(p, r).alias(f"{r}_{p}") for p in ("requests", "limits") for r in ("cpu", "memory")))


def allocation_rollup(observations: DataFrame, end: datetime | None = None) -> DataFrame:
    """T4: containers, those without requests, sums and some pod names by namespace."""
    rows = container_rows(observations, end)
    none = F.col("cpu_requests").isNull() & F.col("memory_requests").isNull()
    return rows.groupBy("cluster_id", "namespace").agg(F.count("*").alias("containers"), F.count(F.when(none, 1)).alias("without_requests"), F.sum("cpu_requests").alias("cpu_requests"), F.sum("memory_requests").alias("memory_requests"), F.array_join(F.slice(F.array_sort(F.collect_set(F.when(none, F.col("name")))), 1, 5), ", ").alias("examples"))


def allocation_delta(observations: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Allocation at two times, and the difference."""
    a, b = (allocation_rollup(observations, t).select("cluster_id", "namespace", F.col("cpu_requests").alias(f"cpu_{n}"), F.col("memory_requests").alias(f"memory_{n}")) for t, n in ((start, "start"), (end, "end")))
    d = a.join(b, ["cluster_id", "namespace"], "full_outer").fillna(0.0)
    return d.withColumns({f"{r}_delta": F.col(f"{r}_end") - F.col(f"{r}_start") for r in ("cpu", "memory")})


def presence_intervals(observations: DataFrame, kind: str, start: datetime, end: datetime) -> DataFrame:
    """When each object was there in a window: from the window's start where it was there before, else from its first sighting, to its first deletion."""
    mine = observations.where((F.col("kind") == kind) & F.col("observation_type").isin("ADDED", "MODIFIED", "DELETED"))
    last = F.struct("observed_at", "observation_type")
    base = mine.where(F.col("observed_at") < moment(mine, "observed_at", start)).groupBy(*REFS).agg(F.max("observed_at").alias("baseline_observed_at"), F.max_by("observation_type", last).alias("t")).where("t <> 'DELETED'").drop("t")
    inside = mine.where((F.col("observed_at") >= moment(mine, "observed_at", start)) & (F.col("observed_at") < moment(mine, "observed_at", end))).groupBy(*REFS).agg(F.min(F.when(F.col("observation_type") != "DELETED", F.col("observed_at"))).alias("first_present_at"), F.min(F.when(F.col("observation_type") == "DELETED", F.col("observed_at"))).alias("first_deleted_at"), F.count("*").alias("observation_rows"))
    old = base.join(inside, REFS, "left").select(*REFS, F.lit(1).alias("from_baseline"), moment(mine, "observed_at", start).alias("interval_start"), F.col("first_deleted_at").alias("interval_end"), F.coalesce("observation_rows", F.lit(0)).alias("observation_rows"))
    new = inside.where("first_present_at IS NOT NULL").join(base, REFS, "left_anti").select(*REFS, F.lit(0).alias("from_baseline"), F.col("first_present_at").alias("interval_start"), F.col("first_deleted_at").alias("interval_end"), "observation_rows")
    return old.unionByName(new)


def presence_peak(intervals: DataFrame, *by: str) -> DataFrame:
    """The largest number of intervals open at one time, by the given columns; ends come before starts of the same time.

    Steps of equal time are added up first. Those of a minute are swept in one task, on top of the sum of all minutes before it; sums by
    minute are few, as the calendar bounds them.
    """
    keys = list(by) or ["cluster_id"]
    starts = intervals.select(*keys, F.col("interval_start").alias("t"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = intervals.where("interval_end IS NOT NULL").select(*keys, F.col("interval_end").alias("t"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    steps = starts.union(ends).groupBy(*keys, "t").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    zoned = dict(steps.dtypes)["t"] == "timestamp"
    minute = F.floor(F.unix_micros("t") / 60_000_000) if zoned else F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', t)") / 60_000_000)
    steps = steps.withColumn("minute", minute)
    rows = lambda *by, to: Window.partitionBy(*keys, *by).rowsBetween(Window.unboundedPreceding, to)
    sums = steps.groupBy(*keys, "minute").agg(F.sum(F.col("up") - F.col("down")).alias("n"))
    before = sums.select(*keys, "minute", F.coalesce(F.sum("n").over(rows(to=-1).orderBy("minute")), F.lit(0)).alias("before"))
    within = steps.withColumn("open", F.sum(F.col("up") - F.col("down")).over(rows("minute", to=0).orderBy("t")))
    most = within.groupBy(*keys, "minute").agg(F.max("open").alias("most"))
    met = most.alias("m").join(before.alias("b"), [F.col(f"m.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "minute")])
    return met.groupBy(*(F.col(f"m.{c}").alias(c) for c in keys)).agg(F.max(F.col("most") + F.col("before")).alias("peak"))


def endpoint_readiness(observations: DataFrame, end: datetime | None = None) -> DataFrame:
    """Endpoints of live slices; a slice without endpoints keeps one row."""
    slices = latest_docs(observations, "EndpointSlice", end)
    points = F.from_json(_at("doc", "endpoints"), "array<struct<targetRef:struct<kind:string,name:string>,conditions:struct<ready:boolean,serving:boolean,terminating:boolean>>>")
    rows = slices.select(*REFS, _at("doc", "metadata", "labels", "kubernetes.io/service-name").alias("service"), F.explode_outer(points).alias("e"))
    return rows.groupBy("cluster_id", "namespace", "service").agg(F.countDistinct("name").alias("slices"), F.count("e").alias("endpoints"), F.count(F.when(F.col("e.conditions.ready"), 1)).alias("ready"))


def node_capacity(observations: DataFrame) -> DataFrame:
    """Live nodes with type, pool and capacities as text and numbers."""
    n = latest_docs(observations, "Node")
    kind = _at("doc", "metadata", "labels", "node.kubernetes.io/instance-type")
    parts = {f"{p}_{r}": _at("doc", "status", p, r) for p in ("capacity", "allocatable") for r in ("cpu", "memory")}
    out = n.select("cluster_id", "name", "uid", "last_seen", F.when(kind == "", "unknown").otherwise(kind).alias("instance_type"), *(v.alias(k) for k, v in parts.items()))
    return out.withColumns({f"{k}_n": quantity_to_double(F.col(k)) for k in parts})


def interval_enrich(events: DataFrame, observations: DataFrame, keys: list[str], value: str, when: str = "ts", before_min: int = 30, after_min: int = 60, keep: Column | None = None) -> DataFrame:
    """Each event with the newest value of a row of the same keys within a time range around it, and the number of rows there."""
    return newest_within(events, observations, keys, value, when, before_s=60 * before_min, after_s=60 * after_min, keep=keep)


def node_lifecycle(observations: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Nodes added and deleted in a window, with the instance type that a nearby document tells."""
    n = observations.where("kind = 'Node'")
    life = between(n.where(F.col("observation_type").isin("ADDED", "DELETED")), "observed_at", start, end).groupBy("cluster_id", "observation_type", "name", "uid").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))
    label = "node.kubernetes.io/instance-type"
    out = interval_enrich(life, n, ["cluster_id", "name"], "doc", "first_seen", keep=F.col("doc").contains(label))
    return out.select("cluster_id", "observation_type", "name", "uid", "first_seen", "last_seen", _at("enriched", "metadata", "labels", label).alias("instance_type"))


def value_history(changes: DataFrame, path_like: str) -> DataFrame:
    """Values of a path by object, neighbours that are equal taken together."""
    w = Window.partitionBy("cluster_id", "object_id", "path").orderBy("ts", "new_scalar")
    c = changes.where(F.col("path").like(path_like)).withColumn("_before", F.lag("new_scalar").over(w))
    return c.where(F.col("_before").isNull() | (F.col("_before") != F.col("new_scalar"))).drop("_before")


def resize_candidates(changes: DataFrame, path_like: str = "%storage%") -> DataFrame:
    """Objects with more than one value of a path."""
    v = changes.where(F.col("path").like(path_like)).groupBy("cluster_id", "object_id", "path").agg(F.array_sort(F.collect_set("new_scalar")).alias("values"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return v.where(F.size("values") > 1)


def doc_fields(versions: DataFrame) -> DataFrame:
    """Top-level fields of documents by kind."""
    return versions.select("kind", F.explode(F.json_object_keys("doc")).alias("field")).groupBy("kind", "field").agg(F.count("*").alias("rows"))


def object_proof(versions: DataFrame, object_id: str, limit: int = 5) -> DataFrame:
    """An object's newest versions."""
    return versions.where(F.col("object_id") == object_id).orderBy(F.desc("seq")).limit(limit)


def conditional_counts(facts: DataFrame, key: str, value: str, least: int = 1) -> DataFrame:
    """By object, all rows of a key and those with a value, where there are at least so many of these."""
    hit = F.count(F.when(F.col("fact_value") == value, 1))
    return facts.where(F.col("fact_key") == key).groupBy("cluster_id", "object_id").agg(F.count("*").alias("rows"), hit.alias("hits"), F.max(F.when(F.col("fact_value") == value, F.col("ts"))).alias("last_hit")).where(F.col("hits") >= least)


def transitions(facts: DataFrame, key: str) -> DataFrame:
    """Rows of a key whose value isn't the object's previous one."""
    w = Window.partitionBy("cluster_id", "object_id").orderBy("ts", "fact_value")
    f = facts.where(F.col("fact_key") == key).withColumn("previous", F.coalesce(F.lag("fact_value").over(w), F.lit("")))
    return f.where(F.col("previous") != F.col("fact_value"))


def churn(observations: DataFrame) -> DataFrame:
    """Additions and deletions by kind and namespace."""
    n = lambda t: F.count(F.when(F.col("observation_type") == t, 1))
    return observations.groupBy("cluster_id", "kind", "namespace").agg(n("ADDED").alias("added"), n("MODIFIED").alias("modified"), n("DELETED").alias("deleted"))


def latest_pivot(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Newest numbers of some keys by object, as columns."""
    last = F.struct("ts", "numeric_value")
    newest = facts.where(F.col("fact_key").isin(keys)).groupBy("cluster_id", "object_id", "fact_key").agg(F.max_by("numeric_value", last).alias("v"))
    return newest.groupBy("cluster_id", "object_id").agg(*(F.max(F.when(F.col("fact_key") == k, F.col("v"))).alias(k.replace(".", "_")) for k in keys))


def node_totals(facts: DataFrame) -> DataFrame:
    """Capacities added up by cluster."""
    keys = ["node_capacity.cpu", "node_capacity.memory", "node_capacity.pods"]
    return latest_pivot(facts, keys).groupBy("cluster_id").agg(F.count("*").alias("nodes"), *(F.sum(k.replace(".", "_")).alias(k.split(".")[1]) for k in keys))


def paired_facts(facts: DataFrame, key: str, value: str, other: str) -> DataFrame:
    """Counts of one key's values in rows of objects and times at which another key has a value."""
    a = facts.where((F.col("fact_key") == key) & (F.col("fact_value") == value)).select("cluster_id", "object_id", "ts")
    b = facts.where(F.col("fact_key") == other).select("cluster_id", "object_id", "ts", F.col("fact_value").alias("value"))
    return a.join(b, ["cluster_id", "object_id", "ts"]).groupBy("value").agg(F.count("*").alias("rows"), F.countDistinct("object_id").alias("objects"))


def event_objects(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Events with the objects they are about and their reason."""
    e = edges.where(F.col("edge_type").startswith("event_")).select("cluster_id", F.col("src_id").alias("object_id"), "edge_type", "dst_id", "dst_kind", F.col("valid_from").alias("ts"))
    reason = facts.where("fact_key = 'k8s_event.reason'").select("cluster_id", "object_id", "ts", F.col("fact_value").alias("reason"))
    return e.join(reason, ["cluster_id", "object_id", "ts"], "left")


def two_hops(edges: DataFrame, first: str, second: str, first_reversed: bool = False) -> DataFrame:
    """Pairs of edges that meet; first_reversed goes from the first edge's target (a service) to its source (a slice)."""
    a = edges.where(F.col("edge_type") == first)
    a = a.select("cluster_id", *((F.col("dst_id").alias("start_id"), F.col("src_id").alias("middle_id")) if first_reversed else (F.col("src_id").alias("start_id"), F.col("dst_id").alias("middle_id")))).distinct()
    b = edges.where(F.col("edge_type") == second).select("cluster_id", F.col("src_id").alias("middle_id"), F.col("dst_id").alias("end_id")).distinct()
    return a.join(b, ["cluster_id", "middle_id"]).select("cluster_id", "start_id", "middle_id", "end_id")


def service_pods(edges: DataFrame) -> DataFrame:
    """Service to slice to pod."""
    return two_hops(edges, "endpointslice_for_service", "endpointslice_targets_pod", first_reversed=True)


def edges_of(edges: DataFrame, prefix: str) -> DataFrame:
    """Current edges of a family (rbac_, webhook_, certmanager_)."""
    return edges.where(F.col("edge_type").startswith(prefix)).groupBy("edge_type", "src_id", "dst_id").agg(F.max("valid_from").alias("last_seen"))


def named_edges(edges: DataFrame, objects: DataFrame, wanted: Column) -> DataFrame:
    """Wanted edges between objects that are known (cluster_id, object_id, kind, namespace, name), with kind, namespace and name of both ends."""
    e = edges.where(wanted).groupBy("cluster_id", "edge_type", "src_id", "dst_id").agg(F.max("valid_from").alias("last_seen"))
    end = lambda side, as_: objects.select("cluster_id", F.col("object_id").alias(f"{side}_id"), *(F.col(c).alias(f"{as_}_{c}") for c in ("kind", "namespace", "name")))
    return e.join(end("src", "source"), ["cluster_id", "src_id"]).join(end("dst", "target"), ["cluster_id", "dst_id"])


def rbac_chain(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Bindings with the roles they grant and the subjects they bind."""
    return named_edges(edges, objects, F.col("edge_type").isin("rbac_binding_binds_subject", "rbac_binding_grants_role"))


def webhook_services(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Webhooks of admission, conversion and API services, and the services behind them."""
    return named_edges(edges, objects, F.col("edge_type").isin("webhook_uses_service", "crd_conversion_webhook_uses_service", "apiservice_uses_service"))


def certificate_chain(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Certificates and what they were asked for, issued and stored by."""
    return named_edges(edges, objects, F.col("edge_type").startswith("certmanager_"))


def fact_inventory(facts: DataFrame) -> DataFrame:
    """Fact keys with their rows, objects, values and worst severity."""
    return facts.groupBy("fact_key").agg(F.count("*").alias("rows"), F.countDistinct("object_id").alias("objects"), F.countDistinct("fact_value").alias("values"), F.max("severity").alias("max_severity"))


def overview(observations: DataFrame, versions: DataFrame, facts: DataFrame, edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows and newest time of each table by cluster."""
    parts = (("observations", observations, "observed_at"), ("versions", versions, "observed_at"), ("facts", facts, "ts"), ("edges", edges, "valid_from"), ("changes", changes, "ts"))
    counts = [df.groupBy("cluster_id").agg(F.count("*").alias("rows"), F.max(when).alias("newest")).select("cluster_id", F.lit(name).alias("table"), "rows", "newest") for name, df, when in parts]
    return reduce(DataFrame.unionByName, counts)


def kind_distribution(versions: DataFrame) -> DataFrame:
    """Objects, versions and bytes by kind."""
    return versions.groupBy("cluster_id", "kind").agg(F.countDistinct("object_id").alias("objects"), F.count("*").alias("versions"), F.sum("raw_size").alias("bytes"))


def severe_facts(facts: DataFrame, least: int = 60, limit: int = 100) -> DataFrame:
    """Facts of a severity, newest first."""
    return facts.where(F.col("severity") >= least).orderBy(F.desc("ts"), "object_id", "fact_key").limit(limit)


def degraded_streams(offsets: DataFrame) -> DataFrame:
    """Streams whose newest status isn't ok."""
    from ..operators.versions import merged_offsets

    return merged_offsets(offsets).where("status NOT IN ('ok', 'listed', 'watching')")


def service_topology_counts(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Slices and pods of each service. rows: edges there are about, where known; large ones are dealt over tasks by it.

    An edge that comes again is dropped before the join, and slices are counted as they are, not as often as the join with pods repeats them.
    """
    e = edges.select("cluster_id", "edge_type", "src_id", "dst_id")
    by_slice = lambda df: dealt(df, rows or 0, "cluster_id", "slice_id").distinct()
    s = by_slice(e.where("edge_type = 'endpointslice_for_service'").select("cluster_id", F.col("dst_id").alias("service_id"), F.col("src_id").alias("slice_id")))
    p = by_slice(e.where("edge_type = 'endpointslice_targets_pod'").select("cluster_id", F.col("src_id").alias("slice_id"), F.col("dst_id").alias("pod_id")))
    ends = s.select("cluster_id", "service_id", F.col("slice_id").alias("id"), F.lit("slice").alias("end")).unionByName(s.join(p, ["cluster_id", "slice_id"]).select("cluster_id", "service_id", F.col("pod_id").alias("id"), F.lit("pod").alias("end")))
    count = lambda end: F.count(F.when(F.col("end") == end, F.col("id"))).alias(f"{end}s")
    return dealt(ends, 4 * (rows or 0), "cluster_id", "service_id").distinct().groupBy("cluster_id", "service_id").agg(count("slice"), count("pod"))


def inventory(versions: DataFrame) -> DataFrame:
    """Objects and versions by kind and namespace."""
    return versions.groupBy("cluster_id", "kind", "namespace").agg(F.countDistinct("object_id").alias("objects"), F.count("*").alias("versions"))


def message_search(facts: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """Event messages with a term."""
    f = facts.where((F.col("fact_key") == "k8s_event.message_preview") & F.lower("fact_value").contains(term.lower()))
    return f.orderBy(F.desc("ts"), "object_id").limit(limit)


def reason_by_namespace(facts: DataFrame, reason: str = "OOMKilled") -> DataFrame:
    """Objects with a container reason, by namespace."""
    f = facts.where(F.col("fact_key").isin("pod_status.reason", "pod_status.last_reason") & (F.col("fact_value") == reason))
    return f.groupBy("cluster_id", "namespace").agg(F.countDistinct("object_id").alias("pods"), F.max("ts").alias("last_ts"))


def restarts_by_namespace(facts: DataFrame) -> DataFrame:
    """Restarts, as the largest count of each pod, by namespace."""
    per = facts.where("fact_key = 'pod_status.restart_count'").groupBy("cluster_id", "namespace", "object_id").agg(F.max("numeric_value").alias("n"))
    return per.groupBy("cluster_id", "namespace").agg(F.sum("n").alias("restarts"), F.count(F.when(F.col("n") > 0, 1)).alias("pods"))


RECIPES: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (coverage_latest, fact_rollup, change_rollup, allocation_rollup, container_rows, allocation_delta, presence_intervals, presence_peak, endpoint_readiness, node_capacity, node_lifecycle, interval_enrich, resize_candidates, value_history, doc_fields, object_proof, conditional_counts, transitions, churn, latest_pivot, node_totals, paired_facts, event_objects, two_hops, service_pods, edges_of, named_edges, rbac_chain, webhook_services, certificate_chain, fact_inventory, overview, kind_distribution, severe_facts, degraded_streams, service_topology_counts, inventory, message_search, reason_by_namespace, restarts_by_namespace)}


def page_after(df: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next rows by keys (unique together; null first) behind the last row of the page before, or the first ones. A comparison for each
    key, so that the scan can skip what lies before."""
    if after is not None:
        behind = F.lit(False)
        for i, key in enumerate(keys):
            same = F.lit(True)
            for k, v in zip(keys[:i], after, strict=False):
                same = same & (F.col(k).isNull() if v is None else F.col(k) == F.lit(v))
            behind = behind | (same & (F.col(key).isNotNull() if after[i] is None else F.col(key) > F.lit(after[i])))
        df = df.where(F.coalesce(behind, F.lit(False)))
    return df.orderBy(*(F.asc_nulls_first(k) for k in keys)).limit(size)

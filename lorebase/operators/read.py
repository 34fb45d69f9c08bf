"""Read operators over evidence tables.

tables is a dict of DataFrames by the names in schema.TABLES (object_aliases may be missing where ids are canonical already). Only operators that
answer about one object collect, and only a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.documents import doc_diff
from ..functions.scalars import clamp, moment
from ..schema import Tables
from .trigrams import TextIndex
from .versions import OBJECT, canonicalize, latest, merged_offsets


class NotFound(LookupError):
    pass


class Ambiguous(LookupError):
    pass


@dataclass
class Target:
    kind: str = ""
    namespace: str = ""
    name: str = ""
    uid: str = ""
    cluster_id: str = ""


def matching(df: DataFrame, **wanted: str) -> DataFrame:
    """Rows whose columns have the wanted values; empty ones ask for nothing."""
    for column, value in wanted.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def between(df: DataFrame, column: str, start: datetime | None, end: datetime | None) -> DataFrame:
    """Both ends inclusive, either may be open."""
    df = df if start is None else df.where(F.col(column) >= moment(df, column, start))
    return df if end is None else df.where(F.col(column) <= moment(df, column, end))


def overlapping(edges: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Edges valid at some time of a window; an edge without an end goes on."""
    df = edges if end is None else edges.where(F.col("valid_from") <= moment(edges, "valid_from", end))
    return df if start is None else df.where(F.col("valid_to").isNull() | (F.col("valid_to") >= moment(edges, "valid_to", start)))


def find_object(tables: Tables, target: Target) -> dict:
    """The one object a target means; NotFound or Ambiguous otherwise."""
    if not target.uid and not (target.kind and target.name):
        raise ValueError("a target needs a uid, or a kind and a name")
    rows = matching(tables["versions"], uid=target.uid, kind=target.kind, namespace=target.namespace, name=target.name, cluster_id=target.cluster_id)
    identity = ["cluster_id", "object_id", "kind", "namespace", "name", "uid"]
    found = rows.groupBy(*identity).agg(F.max("observed_at").alias("seen")).orderBy(F.desc("seen"), F.desc("object_id")).limit(2).collect()
    if not found:
        raise NotFound(f"no object matches {target}")
    if len(found) > 1 and not target.cluster_id:
        raise Ambiguous(f"more than one object matches {target}")
    return found[0].asDict()


def latest_object(tables: Tables, kind: str) -> dict | None:
    """R2: the newest object, of the kind if there is one."""
    order = [F.when(F.col("kind") == kind, 0).otherwise(1), F.desc("observed_at"), F.desc("object_id")]
    row = tables["versions"].select(*OBJECT, "kind", "namespace", "name", "uid", "observed_at").orderBy(*order).limit(1).collect()
    return row[0].asDict() if row else None


def objects(versions: DataFrame) -> DataFrame:
    """Each object's reference columns as last seen."""
    cols = ["api_group", "api_version", "resource", "kind", "namespace", "name", "uid"]
    last = F.struct("observed_at", "seq")
    return versions.groupBy(*OBJECT).agg(*(F.max_by(c, last).alias(c) for c in cols if c in versions.columns), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))


def ids_of(tables: Tables, cluster_id: str, object_id: str) -> DataFrame:
    """An object's id and all its aliases."""
    spark = tables["versions"].sparkSession
    own = spark.createDataFrame([(cluster_id, object_id)], "cluster_id string, id string")
    a = tables.get("object_aliases")
    if a is None:
        return own
    mine = a.where((F.col("cluster_id") == cluster_id) & ((F.col("object_id") == object_id) | (F.col("alias_id") == object_id))).select("cluster_id", "object_id").distinct()
    all_of = a.join(mine, ["cluster_id", "object_id"], "left_semi")
    return own.union(all_of.select("cluster_id", "alias_id")).union(all_of.select("cluster_id", "object_id")).distinct()


def rows_of(tables: Tables, table: str, cluster_id: str, object_id: str) -> DataFrame:
    """Facts, changes (by object) or edges (by source) of an object under any of its ids, by time."""
    column, when = ("src_id", "valid_from") if table == "edges" else ("object_id", "ts")
    ids = ids_of(tables, cluster_id, object_id).withColumnRenamed("id", column)
    return tables[table].join(F.broadcast(ids), ["cluster_id", column], "left_semi").orderBy(when)


def history_counts(marked: DataFrame) -> DataFrame:
    """Per object and version: sightings, how many changed nothing, first and last seen, newest resource version. marked comes from changed()."""
    return marked.groupBy(*OBJECT, "seq").agg(F.count("*").alias("observation_count"), F.count(F.when(F.col("content_changed"), 1)).alias("changed_count"), F.count(F.when(~F.col("content_changed"), 1)).alias("unchanged_count"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.max_by("resource_version", F.struct("observed_at", "resource_version")).alias("resource_version"))


def history_summary(marked: DataFrame) -> DataFrame:
    """R9."""
    return marked.groupBy(*OBJECT).agg(F.max("seq").alias("versions"), F.count("*").alias("observations"), F.count(F.when(F.col("content_changed"), 1)).alias("changed"), F.count(F.when(~F.col("content_changed"), 1)).alias("unchanged"))


def version_diffs(versions: DataFrame, most: int = 50) -> DataFrame:
    """Each version's differences from the one before; the first has none before it."""
    w = Window.partitionBy(*OBJECT).orderBy("seq")
    d = versions.withColumn("before", F.lag("doc").over(w)).where("before IS NOT NULL").withColumn("d", doc_diff(F.col("before"), F.col("doc"), most))
    return d.select(*OBJECT, "seq", "observed_at", "d.changes", "d.truncated")


def history(tables: Tables, marked: DataFrame, target: Target, start: datetime | None = None, end: datetime | None = None, max_versions: int = 50, max_observations: int = 100) -> dict[str, DataFrame]:
    """Versions seen in the window with their counts (newest first), observations, differences and summary of one object."""
    found = find_object(tables, target)
    mine = marked.where((F.col("cluster_id") == found["cluster_id"]) & (F.col("object_id") == found["object_id"]))
    seen = between(mine, "observed_at", start, end)
    counts = history_counts(mine).join(seen.select(*OBJECT, "seq").distinct(), [*OBJECT, "seq"], "left_semi").orderBy(F.desc("seq")).limit(clamp(max_versions, 50, 1000))
    docs = tables["versions"].where((F.col("cluster_id") == found["cluster_id"]) & (F.col("object_id") == found["object_id"]))
    return {"versions": counts, "observations": seen.orderBy(F.desc("observed_at")).limit(clamp(max_observations, 100, 5000)), "diffs": version_diffs(docs), "summary": history_summary(mine)}


def top_per_object(df: DataFrame, n: int, *order: Column, keys: tuple[str, ...] = tuple(OBJECT)) -> DataFrame:
    """The first n rows of each object."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_i") <= n).drop("_i")


def _hits(df: DataFrame, columns: list[str], terms: list[str]) -> Column:
    text = F.lower(F.concat_ws("\n", *columns))
    ok = F.lit(True)
    for t in terms:
        ok = ok & text.contains(t.lower())
    return ok


#: The columns that a search looks through, by table.
SEARCHED = {"facts": ["fact_key", "fact_value", "detail"], "changes": ["change_family", "path", "old_scalar", "new_scalar"]}


def search_indexes(tables: Tables, folder: str) -> dict[str, TextIndex]:
    """Trigram indexes of the searched tables below a folder, with an entry for each object."""
    return {t: TextIndex.build(tables[t], tuple(OBJECT), F.concat_ws("\n", *columns), f"{folder}/{t}") for t, columns in SEARCHED.items()}


def _near(df: DataFrame, table: str, terms: list[str], indexes: Mapping[str, TextIndex] | None) -> DataFrame:
    """Rows of objects that may have the terms, by the table's index if there is one."""
    found = indexes[table].candidates(terms) if indexes and table in indexes else None
    return df if found is None else df.join(found, OBJECT, "left_semi")


def search(tables: Tables, query: str, cluster_id: str = "", kind: str = "", namespace: str = "", start: datetime | None = None, end: datetime | None = None, limit: int = 20, change_score: int = 15, documents: bool = False, cap_rows: bool = True, indexes: Mapping[str, TextIndex] | None = None) -> DataFrame:
    """Objects whose facts and changes (and newest documents) hold all terms of the query, best first.

    With indexes (of search_indexes()) only rows of objects that have the terms' trigrams are looked at; the answer is the same.
    cap_rows keeps the columnar rule: of each table only the newest min(limit or 50, 500) x 20 hits count. Scores: facts 20 + severity, changes change_score + severity, documents 10.
    """
    terms = [t.strip("\"'") for t in query.split()]
    where = {"cluster_id": cluster_id, "kind": kind, "namespace": namespace}
    cap = min(limit or 50, 500) * 20
    newest = lambda df: df.orderBy(F.desc("ts"), "object_id").limit(cap) if cap_rows else df
    base = [*OBJECT, "kind", "namespace", "name", "ts"]
    facts = _near(between(matching(tables["facts"], **where), "ts", start, end), "facts", terms, indexes)
    facts = newest(facts.where(_hits(facts, SEARCHED["facts"], terms))).select(*base, (F.lit(20) + F.col("severity")).alias("score"), F.concat(F.lit("fact:"), F.col("fact_key")).alias("reason"))
    changes = _near(between(matching(tables["changes"], **where), "ts", start, end), "changes", terms, indexes)
    changes = newest(changes.where(_hits(changes, SEARCHED["changes"], terms))).select(*base, (F.lit(change_score) + F.col("severity")).alias("score"), F.concat(F.lit("change:"), F.col("path")).alias("reason"))
    hits = facts.unionByName(changes)
    if documents:
        docs = between(matching(tables["versions"], **where), "observed_at", start, end)
        docs = latest(docs.select(*OBJECT, "kind", "namespace", "name", "observed_at", "seq", "doc"), *OBJECT)
        hits = hits.unionByName(docs.where(_hits(docs, ["doc"], terms)).select(*OBJECT, "kind", "namespace", "name", F.col("observed_at").alias("ts"), F.lit(10).alias("score"), F.lit("document").alias("reason")))
    last = F.struct("ts", "kind", "namespace", "name")
    out = hits.groupBy(*OBJECT).agg(F.max_by("kind", last).alias("kind"), F.max_by("namespace", last).alias("namespace"), F.max_by("name", last).alias("name"), F.sum("score").cast("long").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.max("ts").alias("latest"))
    return out.orderBy(F.desc("score"), "object_id").limit(clamp(limit, 20, 1000))


#: Ids up to which they are sent along as literals, which scans can use; rows up to which a frontier is broadcast.
FEW_IDS, FEW_ROWS = 1000, 500_000


def neighbour_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch ids (cluster_id, id), with direction and the far end; one between two ids has a row for each.

    A handful of ids is a filter on both ends, in one pass over the edges; more of them are two equi-joins.
    """
    found = [(r["cluster_id"], r["id"]) for r in ids.select("cluster_id", "id").limit(FEW_IDS + 1).collect()]
    if len(found) <= FEW_IDS:
        by_cluster: dict[str, list[str]] = {}
        for c, i in found:
            by_cluster.setdefault(c, []).append(i)

        def among(end: str) -> Column:
            return reduce(Column.__or__, ((F.col("cluster_id") == c) & F.col(end).isin(listed) for c, listed in by_cluster.items()), F.lit(False))

        out, into = among("src_id"), among("dst_id")
        ways = F.array(F.when(out, "out"), F.when(into, "in"))
        near = edges.where(out | into).withColumn("direction", F.explode(ways)).where("direction IS NOT NULL")
        is_out = F.col("direction") == "out"
        return near.withColumns({"far_id": F.when(is_out, F.col("dst_id")).otherwise(F.col("src_id")), "near_id": F.when(is_out, F.col("src_id")).otherwise(F.col("dst_id"))})
    i = ids.select("cluster_id", "id")
    side = lambda near, far, way: edges.join(i.withColumnRenamed("id", near), ["cluster_id", near], "left_semi").select(*(F.col(c) for c in edges.columns), F.lit(way).alias("direction"), F.col(far).alias("far_id"), F.col(near).alias("near_id"))
    return side("src_id", "dst_id", "out").unionByName(side("dst_id", "src_id", "in"))


def grouped_edges(edges: DataFrame) -> DataFrame:
    """One row for each (type, source, target): first valid_from, last valid_to (null while one goes on), kinds as last seen."""
    last = F.struct("valid_from", "src_kind", "dst_kind")
    end = F.when(F.count(F.when(F.col("valid_to").isNull(), 1)) == 0, F.max("valid_to"))
    return edges.groupBy("cluster_id", "edge_type", "src_id", "dst_id").agg(F.min("valid_from").alias("valid_from"), end.alias("valid_to"), F.max_by("src_kind", last).alias("src_kind"), F.max_by("dst_kind", last).alias("dst_kind"))


def canonical_edges(tables: Tables) -> DataFrame:
    edges = tables["edges"]
    if (a := tables.get("object_aliases")) is not None:
        edges = canonicalize(canonicalize(edges, a, "src_id"), a, "dst_id")
    return edges


def topology(tables: Tables, cluster_id: str, object_id: str, start: datetime | None = None, end: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) one hop around an object."""
    touching = neighbour_edges(overlapping(tables["edges"], start, end), ids_of(tables, cluster_id, object_id))
    e = grouped_edges(canonical_edges(tables | {"edges": touching.drop("direction", "far_id", "near_id").distinct()}))
    e = e.withColumn("direction", F.when(F.col("src_id") == object_id, "out").otherwise("in"))
    ids = e.select("cluster_id", F.explode(F.array(F.struct(F.col("src_id").alias("object_id"), F.col("src_kind").alias("edge_kind")), F.struct(F.col("dst_id").alias("object_id"), F.col("dst_kind").alias("edge_kind")))).alias("n")).select("cluster_id", "n.*")
    nodes = ids.groupBy("cluster_id", "object_id").agg(F.max("edge_kind").alias("edge_kind")).join(objects(tables["versions"]), OBJECT, "left")
    return nodes.withColumn("kind", F.coalesce("kind", "edge_kind")).drop("edge_kind"), e


def expand(edges: DataFrame, roots: DataFrame, rounds: int = 3, through: tuple[str, ...] | None = None, keep: tuple[str, ...] | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """(cluster_id, object_id, kind, hop) of what is reached from roots (cluster_id, object_id, kind) in up to rounds hops, in both directions.

    keep: kinds that count at all; through: kinds from which the search goes on (roots always do). Each round is a join of the
    frontier with the edges, less what was seen; it ends early at an empty frontier. The frontier is written, so lineage stays short.
    """
    e = overlapping(edges, start, end)
    ends = [F.struct(F.col(f"{a}_id").alias("a"), F.col(f"{b}_id").alias("object_id"), F.col(f"{b}_kind").alias("kind")) for a, b in (("src", "dst"), ("dst", "src"))]
    seen = roots.select("cluster_id", "object_id", "kind", F.lit(0).alias("hop"))
    frontier, size = seen, FEW_IDS + 1
    for hop in range(1, rounds + 1):
        go = frontier if hop == 1 or through is None else frontier.where(F.col("kind").isin(*through))
        go = go.select("cluster_id", F.col("object_id").alias("a"))
        if hop == 1:
            size = go.count()
        if size <= FEW_IDS:  # only edges that touch it are turned about
            near = neighbour_edges(e, go.withColumnRenamed("a", "id")).select("cluster_id", F.col("far_id").alias("object_id"), F.when(F.col("direction") == "out", F.col("dst_kind")).otherwise(F.col("src_kind")).alias("kind"))
        else:
            both = e.select("cluster_id", F.explode(F.array(*ends)).alias("e")).select("cluster_id", "e.*")
            near = both.join(F.broadcast(go) if size <= FEW_ROWS else go, ["cluster_id", "a"], "left_semi")
        near = near.groupBy("cluster_id", "object_id").agg(F.max("kind").alias("kind"))
        if keep is not None:
            near = near.where(F.col("kind").isin(*keep))
        known = seen.select("cluster_id", "object_id")
        frontier, size = _cut(near.join(known, ["cluster_id", "object_id"], "left_anti").withColumn("hop", F.lit(hop)))
        if not size:
            break
        seen = seen.unionByName(frontier)
    return seen


def _cut(df: DataFrame) -> tuple[DataFrame, int]:
    """df as a table in the folder that spark.checkpoint.dir names, cut off from its lineage, and its rows; in one local process without that folder, kept in memory."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        path = f"{folder.rstrip('/')}/frontier-{uuid4().hex}"
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    elif spark.sparkContext.master.startswith("local"):
        out = df.persist()
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return out, out.count()


def bundles(tables: Tables, wanted: DataFrame, facts: int = 1000, changes: int = 1000, versions: int = 3) -> DataFrame:
    """A row for each wanted object (cluster_id, object_id) with its newest document, facts, changes, versions and outgoing edges as arrays."""
    semi = lambda df, c="object_id": df.join(wanted.select("cluster_id", F.col("object_id").alias(c)), ["cluster_id", c], "left_semi")

    def listed(df: DataFrame, name: str, columns: list[str], key: str = "object_id") -> DataFrame:
        return df.groupBy("cluster_id", F.col(key).alias("object_id")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    v = semi(tables["versions"])
    doc = v.groupBy(*OBJECT).agg(F.max_by("doc", F.struct("observed_at", "seq")).alias("latest"), F.max("observed_at").alias("latest_at"))
    parts = [
        listed(top_per_object(semi(tables["facts"]), clamp(facts, 1000, 1000), F.desc("ts"), "fact_key", "fact_value"), "facts", ["ts", "fact_key", "fact_value", "severity"]),
        listed(top_per_object(semi(tables["changes"]), clamp(changes, 1000, 1000), F.desc("ts"), "path"), "changes", ["ts", "change_family", "path", "op", "old_scalar", "new_scalar", "severity"]),
        listed(top_per_object(v, clamp(versions, 3, 100), F.desc("seq")), "versions", ["seq", "observed_at", "doc_hash"]),
        listed(semi(canonical_edges(tables), "src_id"), "edges", ["edge_type", "dst_id", "valid_from", "valid_to"], "src_id"),
    ]
    out = wanted.select(*OBJECT).distinct().join(doc, OBJECT, "left")
    for p in parts:
        out = out.join(p, OBJECT, "left")
    return out


def evidence_scores(tables: Tables, by_severity: bool = False) -> DataFrame:
    """A score for each object: facts x 20 + edges x 10 + changes x 15, or edges + sums of (1 + severity) and (3 + severity)."""
    weight = (lambda n: F.lit(n) + F.col("severity")) if by_severity else (lambda n: F.lit(20 if n == 1 else 15))
    edge = F.lit(1 if by_severity else 10)
    parts = tables["facts"].select(*OBJECT, weight(1).alias("s")).unionByName(tables["changes"].select(*OBJECT, weight(3).alias("s"))).unionByName(canonical_edges(tables).select("cluster_id", F.col("src_id").alias("object_id"), edge.alias("s")))
    return parts.groupBy(*OBJECT).agg(F.sum("s").cast("long").alias("score"))


def service_investigation(tables: Tables, namespace: str, name: str, cluster_id: str = "", max_objects: int = 20, by_severity: bool = False, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Objects around a service, ranked, each with its bundle. The search keeps EndpointSlice, Pod, Node and Event and goes on through the first two."""
    root = find_object(tables, Target("Service", namespace, name, cluster_id=cluster_id))
    spark = tables["versions"].sparkSession
    start_at = spark.createDataFrame([(root["cluster_id"], root["object_id"], "Service")], "cluster_id string, object_id string, kind string")
    near = expand(canonical_edges(tables), start_at, rounds=4, through=("EndpointSlice", "Pod"), keep=("EndpointSlice", "Pod", "Node", "Event"), start=start, end=end)
    priority = F.when(F.col("kind") == "Service", -1).when(F.col("kind") == "EndpointSlice", 0).when(F.col("kind") == "Pod", 1).when(F.col("kind") == "Node", 2).when(F.col("kind") == "Event", 3).otherwise(4)
    scored = near.join(evidence_scores(tables, by_severity), OBJECT, "left").withColumn("score", F.coalesce("score", F.lit(0)))
    seen = tables["versions"].groupBy(*OBJECT).agg(F.max("observed_at").alias("newest"))
    scored = scored.join(seen, OBJECT, "left")
    top = scored.orderBy((F.col("hop") > 0).cast("int"), F.desc("score"), priority, F.desc("newest"), "object_id").limit(clamp(max_objects, 20, 1000) + 1)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy((F.col("hop") > 0).cast("int"), F.desc("score"), priority, F.desc("newest"), "object_id")))
    return ranked.join(bundles(tables, ranked.select(*OBJECT)), OBJECT).orderBy("rank")


def investigate(tables: Tables, target: Target, **limits: int) -> DataFrame:
    """The bundle of one object."""
    found = find_object(tables, target)
    spark = tables["versions"].sparkSession
    return bundles(tables, spark.createDataFrame([(found["cluster_id"], found["object_id"])], "cluster_id string, object_id string"), **limits)


def health(tables: Tables, now: datetime, stale_after_s: int = 3600, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A row a stream: newest status and times, live objects, class and stale flag; resources of a cluster never seen are not_started.

    Excluded resources are named bare (core group alone) or as resource.group.
    """
    keys = ["cluster_id", "api_group", "resource"]
    last = F.struct("observed_at", "observation_type")
    live = tables["observations"].withColumn("identity", F.concat_ws("/", "namespace", "name", "uid")).groupBy(*keys, "identity").agg(F.max_by("observation_type", last).alias("t")).where("t <> 'DELETED'").groupBy(*keys).agg(F.count("*").alias("objects"))
    seen = merged_offsets(tables["ingestion_offsets"])
    idle = F.lit(now).cast("timestamp").cast("long") - F.greatest("last_list_at", "last_watch_at", "last_bookmark_at").cast("long")
    status = F.col("status")
    queued = status == "queued"
    seen = seen.withColumn("stale", F.coalesce(idle > stale_after_s, F.lit(True)) & ~queued & ~status.isin("error", "retrying"))
    seen = seen.withColumn("class", F.when(status == "error", "error").when(status == "retrying", "unstable").when(queued, "queued").when(F.col("stale"), "stale").otherwise("ok"))
    clusters = tables["clusters"].select(F.col("name").alias("cluster_id")).union(tables["ingestion_offsets"].select("cluster_id")).distinct()
    # a handful of clusters by a few hundred resources
    expected = clusters.crossJoin(F.broadcast(tables["api_resources"].select("api_group", "resource").distinct()))
    missing = expected.join(seen.select(*keys).distinct(), keys, "left_anti").withColumns({"namespace": F.lit(""), "status": F.lit("not_started"), "error": F.lit(""), "class": F.lit("not_started"), "stale": F.lit(False)})
    out = seen.select(*keys, "namespace", "status", "error", "class", "stale", "last_list_at", "last_watch_at", "last_bookmark_at").unionByName(missing, allowMissingColumns=True).join(live, keys, "left").withColumn("objects", F.coalesce("objects", F.lit(0)))
    if exclude:
        names = F.array(F.when(F.col("api_group") == "", F.col("resource")).otherwise(F.concat_ws(".", "resource", "api_group")))
        out = out.where(~F.arrays_overlap(names, F.array(*map(F.lit, exclude))))
    return out


def health_summary(streams: DataFrame) -> DataFrame:
    """One row: streams by class, and whether coverage is complete."""
    classes = ("ok", "error", "unstable", "queued", "stale", "not_started")
    counts = [F.count(F.when(F.col("class") == c, 1)).alias(c) for c in classes]
    bad = F.count(F.when(F.col("class").isin("error", "unstable", "stale", "not_started"), 1))
    return streams.agg(F.count("*").alias("streams"), *counts, (bad == 0).alias("complete"))


def health_problems(streams: DataFrame, limit: int = 10) -> DataFrame:
    """Streams that aren't well, errors cut to 180 characters."""
    return streams.where("class <> 'ok'").withColumn("error", F.substring("error", 1, 180)).orderBy("cluster_id", "api_group", "resource").limit(clamp(limit, 10, 100))


def list_clusters(tables: Tables) -> DataFrame:
    """Clusters known by name or by evidence, with counts."""
    names = tables["clusters"].select(F.col("name").alias("cluster_id"))
    for t in ("observations", "versions", "facts", "edges"):
        names = names.union(tables[t].select("cluster_id"))
    out = names.distinct()
    for t in ("observations", "versions", "facts", "edges"):
        out = out.join(tables[t].groupBy("cluster_id").agg(F.count("*").alias(t)), "cluster_id", "left")
    return out.fillna(0).orderBy("cluster_id")


def resolve_cluster(names: list[str], asked: str) -> str:
    """The cluster that a name means: exactly, else the one whose tokens hold the asked ones in order."""
    if asked in names:
        return asked
    tokens = [t for t in asked.lower().replace("_", "-").split("-") if t]

    def holds(name: str) -> bool:
        rest = iter(name.lower().replace("_", "-").replace("/", "-").split("-"))
        return all(any(t in part for part in rest) for t in tokens)

    found = [n for n in names if holds(n)]
    if not found:
        raise NotFound(f"no cluster like {asked!r}")
    if len(found) > 1:
        raise Ambiguous(f"{asked!r} may be {', '.join(sorted(found))}")
    return found[0]


def stats(tables: Tables) -> DataFrame:
    """One row of counts, sizes and the compression ratio."""
    v = tables["versions"].agg(F.count("*").alias("versions"), F.countDistinct(F.concat_ws("/", *OBJECT)).alias("objects"), F.countDistinct("doc_hash").alias("distinct_documents"), F.sum("raw_size").alias("raw_bytes"), F.sum("stored_size").alias("stored_bytes"))
    out = v.withColumn("ratio", F.col("raw_bytes") / F.nullif("stored_bytes", F.lit(0)))
    for t in ("observations", "facts", "edges", "changes"):
        out = out.crossJoin(tables[t].agg(F.count("*").alias(t)))
    return out


def kinds_top(versions: DataFrame, limit: int = 20) -> DataFrame:
    """The kinds with the most versions."""
    return versions.groupBy("kind").agg(F.count("*").alias("versions"), F.countDistinct("object_id").alias("objects")).orderBy(F.desc("versions"), "kind").limit(limit)


def stored_bytes(df: DataFrame) -> DataFrame:
    """Files and bytes that a file-backed DataFrame is stored in."""
    return df.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def integrity(tables: Tables, now: datetime) -> DataFrame:
    """The longest time since an offset moved, and secrets whose stored document still has a payload."""
    lag = tables["ingestion_offsets"].agg(F.max(F.lit(now).cast("timestamp").cast("long") - F.col("updated_at").cast("long")).alias("max_lag_s"))
    secrets = tables["versions"].where("resource = 'secrets'").agg(F.count(F.when(F.col("doc").contains('"data"') | F.col("doc").contains('"stringData"'), 1)).alias("secret_payload_violations"))
    return lag.crossJoin(secrets)


def decision_counts(detail: DataFrame, rollup: DataFrame) -> DataFrame:
    """Decisions by filter and outcome, from detail and hourly rows together."""
    keys = ["cluster_id", "filter_name", "outcome", "reason"]
    d = detail.select(*keys, F.lit(1).cast("long").alias("decisions"))
    return d.unionByName(rollup.select(*keys, "decisions")).groupBy(*keys).agg(F.sum("decisions").alias("decisions"))


def sessions(tables: Tables) -> DataFrame:
    """Sessions with the number of their runs and the newest run."""
    runs = tables["agent_runs"]
    last = F.struct("updated_at", "run_id")
    per = runs.groupBy("session_id").agg(F.count("*").alias("runs"), F.max_by("run_id", last).alias("last_run"), F.max_by("status", last).alias("last_status"), F.max_by("answer", last).alias("last_answer"))
    return tables["agent_sessions"].join(per, "session_id", "left").withColumn("runs", F.coalesce("runs", F.lit(0))).orderBy(F.desc("updated_at"), "session_id")


def run_status_counts(tables: Tables) -> DataFrame:
    return tables["agent_runs"].groupBy("status").agg(F.count("*").alias("runs"))


def without_cluster(tables: Tables, cluster_id: str) -> Tables:
    """All tables without a cluster's rows."""
    return {n: df.where(F.col("name" if n == "clusters" else "cluster_id") != cluster_id) if {"cluster_id", "name"} & set(df.columns) and (n == "clusters" or "cluster_id" in df.columns) else df for n, df in tables.items()}


def coverage(tables: Tables) -> DataFrame:
    """Resources discovered or ingested, and which of both."""
    d = tables["api_resources"].select("api_group", "resource").distinct().withColumn("discovered", F.lit(True))
    i = tables["observations"].groupBy("api_group", "resource").agg(F.count("*").alias("observations"))
    return d.join(i, ["api_group", "resource"], "full_outer").select("api_group", "resource", F.coalesce("discovered", F.lit(False)).alias("discovered"), F.coalesce("observations", F.lit(0)).alias("observations"))


def gauges(tables: Tables, streams: DataFrame) -> DataFrame:
    """One row of stats and health for an exporter."""
    return stats(tables).crossJoin(health_summary(streams))

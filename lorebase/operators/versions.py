"""Change detection, versions and latest state in batch (V1-V21). All of it is windows and joins keyed by object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity

OBJECT = ["cluster_id", "object_id"]


def with_identity(observations: DataFrame) -> DataFrame:
    """observations with object_id (logical id) and the hash of the canonical document."""
    return observations.withColumns({"object_id": identity.logical_id(), "doc_hash": identity.doc_hash(F.col("doc"))})


#: What decides the order of an object's rows of one time (X8): the same in batch and stream.
ORDER = ("observed_at", "doc_hash", "observation_type")


def changed(observations: DataFrame, readd_versions: bool = False, order: tuple[str, ...] = ORDER, prior: DataFrame | None = None) -> DataFrame:
    """V1, V2: observations with content_changed and seq, the number of the object's version so far.

    A row is a change where it is a deletion, the object's first, or its hash isn't the previous one; with readd_versions also
    where the previous row was a deletion. prior (cluster_id, object_id, seq, doc_hash, deleted) is the state before this batch (V3).
    """
    w = Window.partitionBy(*OBJECT).orderBy(*order)
    before, gone = F.lag("doc_hash").over(w), F.lag("observation_type").over(w) == "DELETED"
    start: Column = F.lit(0).cast("long")
    df = observations
    if prior is not None:
        p = prior.select(*OBJECT, F.col("seq").alias("_seq"), F.col("doc_hash").alias("_hash"), F.col("deleted").alias("_deleted"))
        df = df.join(p, OBJECT, "left")
        before, gone, start = F.coalesce(before, "_hash"), F.coalesce(gone, "_deleted"), F.coalesce("_seq", F.lit(0)).cast("long")
    new = (F.col("observation_type") == "DELETED") | before.isNull() | (F.col("doc_hash") != before)
    if readd_versions:
        new = new | F.coalesce(gone, F.lit(False))
    df = df.withColumn("content_changed", new).withColumn("_start", start)
    df = df.withColumn("seq", F.col("_start") + F.sum(F.col("content_changed").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.drop("_start", "_seq", "_hash", "_deleted")


def versions(marked: DataFrame) -> DataFrame:
    """Version rows of what changed() marked; every version is kept in full."""
    size = F.length(F.col("doc").cast("binary")).cast("long")
    v = marked.where("content_changed").withColumns({"materialization": F.lit("full"), "blob_ref": F.col("doc_hash"), "raw_size": size, "stored_size": size})
    return v.drop("content_changed", "observation_type", "partial")


def prior_state(observed: DataFrame) -> DataFrame:
    """V3: (cluster_id, object_id, seq, doc_hash, deleted) of each object in marked or versioned rows."""
    last = F.struct("observed_at", "seq")
    deleted = F.max_by(F.col("observation_type") == "DELETED", last) if "observation_type" in observed.columns else F.lit(False)
    return observed.groupBy(*OBJECT).agg(F.max("seq").alias("seq"), F.max_by("doc_hash", last).alias("doc_hash"), deleted.alias("deleted"))


def alias_rows(observations: DataFrame) -> DataFrame:
    """V4: the ids that each object is known by."""
    a = observations.select("cluster_id", identity.logical_id().alias("object_id"), F.explode(identity.aliases()).alias("alias_id"), "kind", "namespace", "name", "observed_at")
    return a.groupBy("cluster_id", "object_id", "alias_id", "kind", "namespace", "name").agg(F.max("observed_at").alias("observed_at"))


def canonical(aliases: DataFrame) -> DataFrame:
    """The newest object of each alias; ties go to the larger id."""
    return aliases.groupBy("cluster_id", "alias_id").agg(F.max_by("object_id", F.struct("observed_at", "object_id")).alias("canonical_id"))


def canonicalize(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Df with ids in column turned into canonical ones; an unknown id stays."""
    c = canonical(aliases).select("cluster_id", F.col("alias_id").alias(column), "canonical_id")
    out = df.join(c, ["cluster_id", column], "left").withColumn(column, F.coalesce("canonical_id", column))
    return out.select(*df.columns)


def infer_kinds(edges: DataFrame, kinds: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Empty src_kind and dst_kind filled from the resource in the id's path; kinds has (resource, kind), one row each."""
    k = F.broadcast(kinds.groupBy("resource").agg(F.min("kind").alias("_kind")))
    for side in ("src", "dst"):
        for place in (2, 3):
            part = F.split_part(F.col(f"{side}_id"), F.lit("/"), F.lit(place))
            edges = edges.join(k, part == k["resource"], "left").withColumn(f"{side}_kind", F.when(F.col(f"{side}_kind") == "", F.coalesce("_kind", F.lit(""))).otherwise(F.col(f"{side}_kind"))).drop("_kind", "resource")
    return edges


def latest(df: DataFrame, *keys: str, order: tuple[str, ...] = ("observed_at", "seq")) -> DataFrame:
    """V7: the newest row of each key, with all its columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def raw_latest(observations: DataFrame) -> DataFrame:
    """V8: the newest document of each live object, as it came."""
    digits = observations.withColumn("_digits", F.length("resource_version"))  # of versions of one time, the larger number is the newer
    return latest(digits, *OBJECT, order=("observed_at", "_digits", "resource_version")).drop("_digits").where("observation_type <> 'DELETED'")


def live_refs(observations: DataFrame) -> DataFrame:
    """V9: the newest type of each identity, without deleted ones."""
    keys = ["cluster_id", "api_group", "resource", "namespace"]
    seen = observations.withColumn("identity", identity.stream_identity())
    last = F.struct("observed_at", "observation_type")
    return seen.groupBy(*keys, "identity").agg(F.max_by("observation_type", last).alias("observation_type"), F.max_by("name", last).alias("name"), F.max_by("uid", last).alias("uid")).where("observation_type <> 'DELETED'")


def relist_deletes(previous: DataFrame, listed: DataFrame, namespace: str = "") -> tuple[DataFrame, DataFrame]:
    """(refs that a list no longer has, refs that the list couldn't show as they are in another namespace)."""
    keys = ["cluster_id", "api_group", "resource", "identity"]
    ident = lambda d: d if "identity" in d.columns else d.withColumn("identity", identity.stream_identity())
    gone = ident(previous).join(ident(listed).select(*keys), keys, "left_anti")
    visible = F.lit(True) if not namespace else F.col("namespace") == namespace
    return gone.where(visible).withColumn("observation_type", F.lit("DELETED")), gone.where(~visible)


def runs(df: DataFrame, value: str = "doc_hash", order: str = "seq") -> DataFrame:
    """Gaps and islands: each row with run, the number of its stretch of equal values, and run_seq, the first order value of it."""
    w = Window.partitionBy(*OBJECT).orderBy(order)
    new = F.lag(value).over(w).isNull() | (F.lag(value).over(w) != F.col(value))
    df = df.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return df.withColumn("run_seq", F.min(order).over(Window.partitionBy(*OBJECT, "run")))


def rehash(versions_df: DataFrame) -> DataFrame:
    """Versions with documents hashed anew; of neighbours that are now equal the first stays, and seq is numbered again."""
    fresh = versions_df.withColumn("doc_hash", identity.doc_hash(F.col("doc")))
    first = runs(fresh).where(F.col("seq") == F.col("run_seq")).drop("run", "run_seq")
    return first.withColumn("seq", F.row_number().over(Window.partitionBy(*OBJECT).orderBy("seq")).cast("long"))


def reindex_input(versions_df: DataFrame, observations: DataFrame) -> DataFrame:
    """Versions as observations again, with the type of the first observation of that version, else MODIFIED."""
    types = observations.groupBy("cluster_id", "object_id", "doc_hash").agg(F.min_by("observation_type", F.struct("observed_at", "observation_type")).alias("observation_type"))
    return versions_df.join(types, ["cluster_id", "object_id", "doc_hash"], "left").withColumn("observation_type", F.coalesce("observation_type", F.lit("MODIFIED")))


def without_facts(versions_df: DataFrame, facts: DataFrame, prefix: str = "service.", kind: str = "Service") -> DataFrame:
    """Versions of a kind that have no fact with the prefix at their time."""
    have = facts.where(F.col("fact_key").startswith(prefix)).select("cluster_id", "object_id", F.col("ts").alias("observed_at")).distinct()
    return versions_df.where(F.col("kind") == kind).join(have, ["cluster_id", "object_id", "observed_at"], "left_anti")


def merged_offsets(offsets: DataFrame) -> DataFrame:
    """One row a stream: status, error and version of the newest event; list, watch and bookmark times are the newest of their kind."""
    keys = ["cluster_id", "api_group", "resource", "namespace"]
    last = F.struct("updated_at", "event")
    new = lambda c: F.max_by(c, last).alias(c)
    valid = offsets.where("cluster_id <> '' AND resource <> ''")
    return valid.groupBy(*keys).agg(new("api_version"), new("kind"), new("namespaced"), new("resource_version"), new("event"), F.coalesce(F.max_by(F.nullif("status", F.lit("")), last), F.lit("ok")).alias("status"), new("error"), F.max("last_list_at").alias("last_list_at"), F.max("last_watch_at").alias("last_watch_at"), F.max("last_bookmark_at").alias("last_bookmark_at"), F.max("updated_at").alias("updated_at"))


def latest_by(df: DataFrame, keys: list[str], order: str, keep_known: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each key; an empty value in keep_known columns doesn't replace a known one."""
    cols = [c for c in df.columns if c not in keys]
    pick = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c) != "", F.col(order))), F.lit("")) if c in keep_known else F.max_by(c, order)
    return df.groupBy(*keys).agg(*(pick(c).alias(c) for c in cols))


def identity_matches(refs: DataFrame) -> DataFrame:
    """Refs with the uid that their name is known by, where they have none themselves; deleted where the newest sighting is a deletion."""
    name = ["cluster_id", "api_group", "resource", "namespace", "name"]
    known = refs.where("uid <> ''").groupBy(*name).agg(F.max_by("uid", F.struct("observed_at", "uid")).alias("_uid"))
    out = refs.join(known, name, "left").withColumn("uid", F.when(F.col("uid") == "", F.coalesce("_uid", F.lit(""))).otherwise(F.col("uid"))).drop("_uid")
    last = F.struct("observed_at", "observation_type")
    return out.groupBy(*name, "uid").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), (F.max_by("observation_type", last) == "DELETED").alias("deleted"))


def placeholder_objects(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Targets of edges that no object row stands for."""
    targets = edges.select("cluster_id", F.col("dst_id").alias("object_id"), F.col("dst_kind").alias("kind")).distinct()
    return targets.join(objects, OBJECT, "left_anti")

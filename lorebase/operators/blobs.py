"""Documents stored once by their hash, and retention that follows references to them (M1)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import moment
from ..schema import Tables
from .versions import OBJECT


def split_documents(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions without their documents, blobs (doc_hash, doc, size) of those: one row a hash). Copies are merged before they are dealt out."""
    blobs = versions.groupBy("doc_hash").agg(F.min("doc").alias("doc")).withColumn("size", F.octet_length("doc").cast("long"))
    return versions.drop("doc"), blobs


def with_documents(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """Versions with their documents again; null where the blob is gone."""
    return versions.join(blobs.select("doc_hash", "doc"), "doc_hash", "left")


def new_blobs(blobs: DataFrame, known: DataFrame) -> DataFrame:
    """Blobs that a table doesn't have yet: what a batch appends to it."""
    return blobs.join(known.select("doc_hash"), "doc_hash", "left_anti")


def references(blobs: DataFrame, versions: DataFrame) -> DataFrame:
    """(doc_hash, size, references) of each blob: how many versions have it."""
    counts = versions.groupBy("doc_hash").agg(F.count("*").alias("references"))
    return blobs.join(counts, "doc_hash", "left").select("doc_hash", "size", F.coalesce("references", F.lit(0)).alias("references"))


@dataclass(frozen=True)
class Policy:
    """Versions older than max_age go, but for the newest min_versions of their object. Empty lists say nothing; values are compared in lower case:
    resources as resource, resource.group or group/version/resource, profiles, and retention classes (columns profile, retention_class; generic and
    standard where a row has none)."""

    name: str
    max_age: timedelta
    min_versions: int = 1
    resources: tuple[str, ...] = ()
    profiles: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()

    def covers(self, df: DataFrame) -> Column:
        text = lambda c, default: F.lower(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))) if c in df.columns else F.lit(default)
        group = F.col("api_group")
        names = [F.lower(F.when(group == "", F.col("resource")).otherwise(F.concat_ws(".", "resource", group))), F.lower(F.when(group == "", F.concat_ws("/", "api_version", "resource")).otherwise(F.concat_ws("/", group, "api_version", "resource")))]
        parts = []
        if self.resources:
            wanted = [x.strip().lower() for x in self.resources]
            parts.append(names[0].isin(wanted) | names[1].isin(wanted))
        if self.profiles:
            parts.append(text("profile", "generic").isin([x.strip().lower() for x in self.profiles]))
        if self.classes:
            parts.append(text("retention_class", "standard").isin([x.strip().lower() for x in self.classes]))
        return reduce(Column.__and__, parts, F.lit(True))


def policy_victims(versions: DataFrame, now: datetime, policies: list[Policy]) -> DataFrame:
    """versions that some policy lets go, with policy, the first that does; never an object's newest. Ranks are by time, then seq."""
    newest_first = Window.partitionBy(*OBJECT).orderBy(F.desc("observed_at"), F.desc("seq"))
    ranked = versions.withColumn("_rank", F.row_number().over(newest_first))
    chosen = F.lit(None).cast("string")
    for p in reversed(policies):
        goes = (F.col("observed_at") < moment(ranked, "observed_at", now - p.max_age)) & (F.col("_rank") > max(1, p.min_versions)) & p.covers(ranked)
        chosen = F.when(goes, p.name).otherwise(chosen)
    return ranked.withColumn("policy", chosen).where("policy IS NOT NULL").drop("_rank")


def retain_by_policy(tables: Tables, now: datetime, policies: list[Policy], sightings_max_age: timedelta | None = None, decisions_max_age: timedelta | None = None) -> tuple[Tables, DataFrame]:
    """(tables that stay, a report of (policy, versions)).

    With a version go its sightings, facts, changes and the edges from it (same object and time); sightings that belong to no version (seq is null) go
    by their own age; then blobs without a version; decisions and their counts by their age. Without any policy or age everything stays.
    """
    gone = policy_victims(tables["versions"], now, policies)
    report = gone.groupBy("policy").agg(F.count("*").alias("versions"))
    version, at = gone.select(*OBJECT, "seq"), gone.select(*OBJECT, F.col("observed_at").alias("ts"))
    out = dict(tables)
    out["versions"] = tables["versions"].join(version, [*OBJECT, "seq"], "left_anti")
    if "seq" in tables["observations"].columns:
        sightings = tables["observations"].join(version, [*OBJECT, "seq"], "left_anti")
        if sightings_max_age is not None:
            sightings = sightings.where(F.col("seq").isNotNull() | (F.col("observed_at") >= moment(sightings, "observed_at", now - sightings_max_age)))
        out["observations"] = sightings
    for t in ("facts", "changes"):
        out[t] = tables[t].join(at, [*OBJECT, "ts"], "left_anti")
    out["edges"] = tables["edges"].join(at.select("cluster_id", F.col("object_id").alias("src_id"), F.col("ts").alias("valid_from")), ["cluster_id", "src_id", "valid_from"], "left_anti")
    if "blobs" in tables:
        out["blobs"] = tables["blobs"].join(out["versions"].select("doc_hash").distinct(), "doc_hash", "left_semi")
    if decisions_max_age is not None:
        for t, when in (("filter_decisions", "ts"), ("filter_rollup", "hour")):
            if t in tables:
                out[t] = tables[t].where(F.col(when) >= moment(tables[t], when, now - decisions_max_age))
    return out, report

"""Maintenance: retention, pruning, compaction (M1-M3, M7). Parquet has no row delete, so each operator returns the tables that stay."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import glob_match, moment
from ..schema import Tables
from .filters import merge_rollups
from .versions import OBJECT


@dataclass(frozen=True)
class Rule:
    """Versions older than max_age go; min_versions newest of an object stay. resource (a glob) or profile narrows the rule."""

    max_age: timedelta
    min_versions: int = 1
    resource: str = ""
    profile: str = ""

    def holds(self, df: DataFrame, now: datetime) -> Column:
        ok = (F.col("observed_at") < moment(df, "observed_at", now - self.max_age)) & (F.col("_rank") > max(1, self.min_versions))
        if self.resource:
            ok = ok & glob_match(F.lower("resource"), self.resource.lower())
        if self.profile:
            ok = ok & (F.col("profile") == self.profile)
        return ok


def retention_victims(versions: DataFrame, now: datetime, rules: list[Rule]) -> DataFrame:
    """M1: versions that some rule lets go; never an object's newest."""
    ranked = versions.withColumn("_rank", F.row_number().over(Window.partitionBy(*OBJECT).orderBy(F.desc("seq"))))
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | r.holds(ranked, now)
    return ranked.where(any_rule).drop("_rank")


def retain(tables: Tables, now: datetime, rules: list[Rule], decisions_max_age: timedelta | None = None) -> Tables:
    """M1: tables without the versions that go, their sightings and evidence (same object and time), and decisions over their own age."""
    gone = retention_victims(tables["versions"], now, rules)
    key = gone.select(*OBJECT, F.col("observed_at").alias("ts"))
    out = dict(tables)
    out["versions"] = tables["versions"].join(gone.select(*OBJECT, "seq"), [*OBJECT, "seq"], "left_anti")
    for t in ("facts", "changes"):
        out[t] = tables[t].join(key, [*OBJECT, "ts"], "left_anti")
    out["edges"] = tables["edges"].join(key.select("cluster_id", F.col("object_id").alias("src_id"), F.col("ts").alias("valid_from")), ["cluster_id", "src_id", "valid_from"], "left_anti")
    if "object_id" in tables["observations"].columns and "seq" in tables["observations"].columns:
        out["observations"] = tables["observations"].join(gone.select(*OBJECT, "seq"), [*OBJECT, "seq"], "left_anti")
    if decisions_max_age is not None and "filter_decisions" in tables:
        out["filter_decisions"] = tables["filter_decisions"].where(F.col("ts") >= moment(tables["filter_decisions"], "ts", now - decisions_max_age))
    return out


def blobs(versions: DataFrame) -> DataFrame:
    """Documents by hash; those that no version refers to are gone by construction."""
    return versions.select("doc_hash", "doc").dropDuplicates(["doc_hash"])


def prune_unreferenced(versions: DataFrame, observations: DataFrame) -> DataFrame:
    """M2: versions that a sighting (cluster_id, object_id, seq) refers to. Without any sightings it refuses."""
    if observations.limit(1).count() == 0:
        raise ValueError("there are no observations; pruning would remove every version")
    return versions.join(observations.select(*OBJECT, "seq").distinct(), [*OBJECT, "seq"], "left_semi")


def compact(tables: Tables, rollup: DataFrame, new_rollup: DataFrame, files: int) -> Tables:
    """M3: pruned versions in fewer files, and merged decision counts."""
    return tables | {"versions": prune_unreferenced(tables["versions"], tables["observations"]).coalesce(files), "decision_rollup": merge_rollups(rollup, new_rollup)}


def retain_runs(tables: Tables, now: datetime, max_age: timedelta) -> Tables:
    """M7: run logs without old failed runs that a later run of their session took over, and without events of runs that are gone."""
    runs = tables["agent_runs"]
    w = Window.partitionBy("session_id").orderBy(F.desc("updated_at"), F.desc("run_id"))
    keep = runs.withColumn("_i", F.row_number().over(w)).where((F.col("_i") == 1) | (F.col("status") == "done") | (F.col("updated_at") >= moment(runs, "updated_at", now - max_age))).drop("_i")
    return tables | {"agent_runs": keep, "agent_run_events": tables["agent_run_events"].join(keep.select("run_id"), "run_id", "left_semi")}

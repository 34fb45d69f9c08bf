"""The ingest pipeline: observations to evidence tables, one plan for batch and micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import filters, profiles
from ..operators.extract import ADDED, split_evidence, with_items
from ..operators.versions import OBJECT, alias_rows, canonicalize, changed, infer_kinds, prior_state, versions
from ..schema import TABLES, Tables
from ..sources.resolver import Resolver

#: Takes rows that several tables are made of and a name, and gives the same rows; a job that stores tables writes them there, once.
Stage = Callable[[DataFrame, str], DataFrame]
#: Takes keys, and gives the rows of a stored table that have them (more rows do no harm).
Lookup = Callable[[DataFrame], DataFrame]


def ingest(
    observations: DataFrame, resolver: Resolver | None = None, chain: Column | None = None, extractor_set: str | None = None, prior: DataFrame | Lookup | None = None,
    readd_versions: bool = True, enrich: bool = False, aliases: Lookup | None = None, stage: Stage | None = None,
) -> Tables:
    """All evidence tables of observations. Filter chain and extractors go by each row's resource profile, unless chain or extractor_set
    says otherwise; secrets always go through the chain that removes their payload. Evidence comes from changed rows alone. CRDs in the
    batch are known before their instances. With enrich, edges are stored as the columnar behaviour has them: targets by their canonical id (aliases of the
    batch, and those that the lookup finds for (cluster_id, alias_id)), empty kinds by the resource in the id; else reads do that.

    prior is the state before the batch, or a lookup of it by (cluster_id, object_id). Filters run once, in the rows that stage gets as
    "filtered", and documents are parsed for evidence once, in those that it gets as "evidence"; without a stage each table repeats them.

    Beside the tables of the schema: latest_raw, the newest document of each live object as it came, secrets redacted; latest_raw_updates, the same
    with deleted objects marked; filter_rollup; object_state, what the next batch goes on from; canonical_ids.
    """
    stage = stage or (lambda df, name: df)
    resolver = (resolver or Resolver()).with_crds(observations.where("kind = 'CustomResourceDefinition'"))
    profiled = profiles.with_profile(observations)
    secret = (F.col("resource") == "secrets") & (F.col("api_group") == "")
    chosen = F.when(secret, "secret_metadata_only").otherwise(F.col("chain") if chain is None else chain)
    redacted = profiled.withColumn("raw", filters.redact_secret(F.col("doc"), F.col("resource")))
    filtered = stage(filters.apply_chains(redacted, chain=chosen).withColumn("object_id", identity.logical_id()), "filtered")

    stored = filters.kept(filtered).withColumn("doc_hash", identity.doc_hash(F.col("doc")))
    before = prior(stored.select(*OBJECT).distinct()) if callable(prior) else prior
    marked = changed(stored, readd_versions, prior=before)
    found = stage(with_items(marked, F.col("extractor_set") if extractor_set is None else extractor_set, F.col("content_changed")), "evidence")
    facts, edges, changes = split_evidence(found, resolver)
    marked = found.drop(*ADDED)
    alias = alias_rows(marked)

    detail, rollup = filters.persisted_decisions(filters.decision_rows(filtered))
    more = ["outcome", "decisions", "profile", "chain", "extractor_set", "raw"]
    updates = raw_updates(filtered)
    pick = lambda df, t: df.select(*(c.strip().split()[0] for c in TABLES[t].split(",")))
    return {
        "observations": marked.drop(*more), "versions": pick(versions(marked), "versions"), "object_aliases": alias,
        "facts": pick(facts, "facts"), "edges": pick(enriched(edges, alias, resolver, aliases) if enrich else edges, "edges"), "changes": pick(changes, "changes"),
        "filter_decisions": pick(detail, "filter_decisions"), "filter_rollup": rollup,
        "latest_raw": updates.where("NOT deleted").drop("deleted"), "latest_raw_updates": updates,
        "object_state": prior_state(marked), "canonical_ids": canonical_ids(alias),
    }


def canonical_ids(aliases: DataFrame) -> DataFrame:
    """(cluster_id, alias_id, object_id, observed_at): the newest object of each alias; ties go to the larger id."""
    newest = F.max_by(F.struct("object_id", "observed_at"), F.struct("observed_at", "object_id"))
    return aliases.groupBy("cluster_id", "alias_id").agg(newest.alias("n")).select("cluster_id", "alias_id", "n.*")


def enriched(edges: DataFrame, aliases: DataFrame, resolver: Resolver, known: Lookup | None = None) -> DataFrame:
    """Edges whose targets go by canonical ids and whose empty kinds are told by the resource in the id."""
    columns = ["cluster_id", "alias_id", "object_id", "observed_at"]
    all_aliases = aliases.select(*columns)
    if known is not None:
        all_aliases = all_aliases.unionByName(known(edges.select("cluster_id", F.col("dst_id").alias("alias_id")).distinct()).select(*columns))
    spark = edges.sparkSession
    kinds = spark.createDataFrame(sorted({(r.resource, r.kind) for r in resolver.known.values()}), "resource string, kind string")
    return infer_kinds(canonicalize(edges, all_aliases, "dst_id"), kinds)


def raw_updates(filtered: DataFrame) -> DataFrame:
    """(cluster_id, object_id, kind, namespace, name, observed_at, doc, deleted) of each object's newest row, before any filter but with
    secret values redacted. A row whose change alone is discarded counts; one whose resource is discarded, or that has no name, doesn't."""
    seen = filtered.where((F.col("outcome") != filters.DISCARD_RESOURCE) & (F.col("name") != ""))
    last = F.struct("observed_at", F.length("resource_version"), "resource_version", "observation_type", F.xxhash64("raw"))
    row = F.struct("kind", "namespace", "name", "observed_at", F.col("raw").alias("doc"), (F.col("observation_type") == "DELETED").alias("deleted"))
    return seen.groupBy(*OBJECT).agg(F.max_by(row, last).alias("n")).select(*OBJECT, "n.*")

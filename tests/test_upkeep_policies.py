"""Streaming rollups, blobs and retention by policy, recipes as SQL functions."""

import json
from datetime import datetime, timedelta

import pytest
from lorebase.operators import blobs, filters, sqlsurface
from lorebase.plans import ingest, recipe_sql, recipes
from lorebase.schema import TABLES, empty
from lorebase.sources.documents import observations
from lorebase.streaming.rollup import hourly_store, rollup_stream
from pyspark.sql import functions as F

from . import fixtures as fx

T0 = datetime(2024, 6, 1)
DECISION = "ts timestamp, cluster_id string, filter_name string, outcome string, reason string"


def decisions(path, name, *minutes):
    path.mkdir(exist_ok=True)
    rows = [json.dumps({"ts": (T0 + timedelta(minutes=m)).isoformat(), "cluster_id": "c", "filter_name": f, "outcome": "keep_modified", "reason": ""}) for m, f in minutes]
    (path / name).write_text("\n".join(rows))


def test_stream_rollup(spark, tmp_path):
    """Two calls go on from each other and equal the batch rollup; what comes after the watermark is left out."""
    source, root = tmp_path / "in", str(tmp_path / "out")
    run = lambda: rollup_stream(spark.readStream.schema(DECISION).option("maxFilesPerTrigger", 1).json(str(source)), root, str(tmp_path / "cp"), "2 hours")
    decisions(source, "1.json", (1, "a"), (5, "a"), (70, "b"))
    run()
    decisions(source, "2.json", (20, "a"), (80, "b"), (600, "a"))
    run()
    read = lambda: {(r["hour"], r["filter_name"]): (r["decisions"], r["first_at"], r["last_at"]) for r in hourly_store(spark, root).read("hourly_counts").collect()}
    batch = filters.hourly_rollup(spark.read.schema(DECISION).json(str(source)))
    assert read() == {(r["hour"], r["filter_name"]): (r["decisions"], r["first_at"], r["last_at"]) for r in batch.collect()}
    before = read()
    decisions(source, "3.json", (30, "a"))  # nine and a half hours behind the newest
    run()
    assert read() == before
    run()
    assert read() == before


def test_policies(spark):
    ref = ("", "v1", "pods")
    rows = [("c", f"o{i}", seq, T0 + timedelta(days=seq), *(ref if i < 2 else ("apps", "v1", "deployments")), "profile" if i == 1 else None, f"h{i}-{seq % 3}", f"doc{i}-{seq % 3}") for i in range(4) for seq in range(1, 7)]
    v = spark.createDataFrame(rows, "cluster_id string, object_id string, seq bigint, observed_at timestamp, api_group string, api_version string, resource string, profile string, doc_hash string, doc string")
    now = T0 + timedelta(days=7)
    P = blobs.Policy
    gone = lambda *p: {(r["object_id"], r["seq"], r["policy"]) for r in blobs.policy_victims(v, now, list(p)).collect()}
    assert gone() == set()
    assert gone(P("all", timedelta(0), 0)) == {(f"o{i}", s, "all") for i in range(4) for s in range(1, 6)}  # never the newest
    assert gone(P("pods", timedelta(days=3), 2, resources=(" Pods ",)), P("rest", timedelta(days=5), 1)) == {(f"o{i}", s, "pods") for i in (0, 1) for s in (1, 2, 3)} | {(f"o{i}", 1, "rest") for i in (2, 3)}
    assert gone(P("d", timedelta(days=5), 1, resources=("apps/v1/deployments",))) == gone(P("d", timedelta(days=5), 1, resources=("deployments.apps",))) == {("o2", 1, "d"), ("o3", 1, "d")}
    assert gone(P("p", timedelta(days=5), profiles=("PROFILE",))) == {("o1", 1, "p")}
    assert gone(P("g", timedelta(days=5), profiles=("generic",), classes=("standard",))) == {(f"o{i}", 1, "g") for i in (0, 2, 3)} and gone(P("x", timedelta(days=5), classes=("long",))) == set()

    refs, stored = blobs.split_documents(v)
    assert stored.count() == 12 and blobs.with_documents(refs, stored).where("doc IS NULL").count() == 0
    assert blobs.new_blobs(stored, stored.where("doc_hash <> 'h0-1'")).first()["doc"] == "doc0-1"
    facts = refs.selectExpr("cluster_id", "object_id", "observed_at AS ts", "'k' fact_key")
    seen = refs.selectExpr("cluster_id", "object_id", "seq", "observed_at").unionByName(refs.selectExpr("cluster_id", "object_id", "CAST(NULL AS BIGINT) seq", "observed_at"))
    edges = refs.selectExpr("cluster_id", "object_id AS src_id", "observed_at AS valid_from")
    old = filters.hourly_rollup(spark.createDataFrame([(T0, "c", "f", "o", ""), (now, "c", "f", "o", "")], DECISION))
    tables = {"versions": refs, "blobs": stored, "facts": facts, "changes": facts, "edges": edges, "observations": seen, "filter_rollup": old}
    out, report = blobs.retain_by_policy(tables, now, [P("pods", timedelta(0), 1, resources=("pods",))], timedelta(days=3), timedelta(days=1))
    assert [tuple(r) for r in report.collect()] == [("pods", 10)]
    assert {t: out[t].count() for t in ("versions", "facts", "changes", "edges", "filter_rollup")} == {"versions": 14, "facts": 14, "changes": 14, "edges": 14, "filter_rollup": 1}
    assert out["observations"].where("seq IS NOT NULL").count() == 14 and out["observations"].where("seq IS NULL").count() == 12
    assert {r["doc_hash"] for r in out["blobs"].collect()} == {"h0-0", "h1-0", *(f"h{i}-{j}" for i in (2, 3) for j in range(3))}
    assert blobs.references(stored, out["versions"]).where("references = 0").count() == 4
    same, none = blobs.retain_by_policy(tables, now, [])
    assert none.count() == 0 and {t: same[t].count() for t in tables} == {t: tables[t].count() for t in tables}


@pytest.fixture(scope="module")
def evidence(spark):
    tables = ingest.ingest(observations(fx.decoded(spark)))
    sqlsurface.register_views({t: df for t, df in tables.items() if t in TABLES} | {"agent_runs": empty(spark, "agent_runs")})
    recipe_sql.install(spark)
    return tables


def test_every_recipe_can_be_called(spark, evidence):
    given = {"recipe_namespace_delta": "TIMESTAMP '2000-01-01', TIMESTAMP '2100-01-01'", "recipe_presence_intervals": "'Pod', TIMESTAMP '2000-01-01', TIMESTAMP '2100-01-01'", "recipe_lifecycle": "'Node'", "recipe_value_changes": "'%'", "recipe_value_history": "'%'", "recipe_object_proof": "'c1/x'"}
    assert len(recipe_sql.RECIPES) == 14
    for name in recipe_sql.RECIPES:
        out = sqlsurface.query_sql(spark, f"SELECT * FROM {name}({given.get(name, '')})")
        assert out.columns and out.row_count >= (0 if name in ("recipe_object_proof", "recipe_value_changes") else 1 if name in ("recipe_fact_rollup", "recipe_coverage_latest", "recipe_doc_fields", "recipe_presence_intervals") else 0), name


def test_recipes_equal_the_builders(spark, evidence):
    rows = lambda df: sorted(map(str, df.collect()))
    names = ["fact_key", "fact_value", "rows", "objects", "max_severity", "last_ts"]
    assert rows(spark.sql(f"SELECT {', '.join(names)} FROM recipe_fact_rollup()")) == rows(recipes.fact_rollup(evidence["facts"]).select(*names))
    names = ["cluster_id", "kind", "objects", "last_seen"]
    assert rows(spark.sql(f"SELECT {', '.join(names)} FROM recipe_coverage_latest(cluster => 'c1')")) == rows(recipes.coverage_latest(evidence["observations"]).select(*names))
    assert spark.sql("SELECT * FROM recipe_coverage_latest(cluster => 'none')").count() == 0
    assert rows(spark.sql("SELECT kind, field, rows FROM recipe_doc_fields()")) == rows(recipes.doc_fields(evidence["versions"]).select("kind", "field", F.col("rows")))
    names = ["cluster_id", "namespace", "service", "slices", "endpoints", "ready"]
    assert rows(spark.sql(f"SELECT {', '.join(names)} FROM recipe_endpointslices()")) == rows(recipes.endpoint_readiness(evidence["observations"]).select(*names))

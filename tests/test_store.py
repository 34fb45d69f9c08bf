"""Commits of batches, keyed tables, reads by month, and the ingest job on top of them."""

import json
from datetime import datetime, timedelta

import pytest
from lorebase.operators import filters
from lorebase.plans import collect
from lorebase.plans.ingest import ingest, raw_updates
from lorebase.sources import sinks, store
from lorebase.sources.store import Store
from pyspark.sql import functions as F

from .test_collect import T0, pod, rows_of

ROWS = "cluster_id string, object_id string, kind string, namespace string, name string, fact_key string, fact_value string, ts timestamp"


def facts(spark, *values, at=T0):
    df = spark.createDataFrame([("c1", f"o{v}", "Pod", "shop", f"o{v}", "k", str(v), at) for v in values], ROWS)
    return df.withColumns({"numeric_value": F.lit(1.0), "severity": F.lit(20), "detail": F.lit("")})


def values(df):
    return sorted(r["fact_value"] for r in df.collect())


def state(spark, *rows):
    return spark.createDataFrame([("c1", f"o{i}", seq, "h", False) for i, seq in rows], store.KEYED["object_state"].schema)


def test_a_batch_is_one_commit(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    assert s.read("facts").count() == s.read("object_state").count() == 0 and s.last_batch() is None
    assert s.commit(0, {"facts": facts(spark, 1), "object_state": state(spark, (1, 1))})
    broken = facts(spark, 3).withColumn("fact_value", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):  # dies between two tables
        s.commit(1, {"object_state": state(spark, (1, 2)), "facts": facts(spark, 2), "changes": None or broken.selectExpr("cluster_id", "ts", "object_id", "kind", "namespace", "name", "'f' change_family", "'p' path", "'o' op", "'' old_scalar", "fact_value new_scalar", "1 severity")})
    assert values(s.read("facts")) == ["1"] and s.read("object_state").first()["seq"] == 1 and s.last_batch() == 0
    assert s.commit(1, {"object_state": state(spark, (1, 2)), "facts": facts(spark, 2)})
    assert not s.commit(1, {"facts": facts(spark, 2)}) and not s.commit(0, {"facts": facts(spark, 9)})
    assert values(s.read("facts")) == ["1", "2"] and [r["seq"] for r in s.read("object_state").collect()] == [2]
    gone = s.vacuum()
    assert {g.split("/")[0] for g in gone} >= {"facts", "object_state"} and values(s.read("facts")) == ["1", "2"]


def test_two_writers_of_a_batch(spark, tmp_path, monkeypatch):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    monkeypatch.setattr(b, "manifests", lambda: [])  # it looked before the other was done
    assert a.commit(0, {"facts": facts(spark, 1)})
    assert not b._put((0, 0), {"batch": 0})
    assert values(a.read("facts")) == ["1"]


def test_folds_and_maintenance(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLD", 3)
    s = Store(spark, str(tmp_path))
    for n in range(7):
        s.commit(n, {"facts": facts(spark, n), "object_state": state(spark, (n, n))})
        if n == 4:
            assert s.compact("facts", files=1) and len(s.state()[0]["facts"]) == 1
    assert values(s.read("facts")) == list("0123456") and s.read("object_state").count() == 7
    s.vacuum()
    assert values(s.read("facts")) == list("0123456") and s.read("object_state").count() == 7


def test_what_a_batch_reads_follows_its_keys(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    s.commit(0, {"object_state": state(spark, *((i, 0) for i in range(400)))})
    read = []
    for n in range(1, 5):  # the same object in each batch
        read.append(s.touched("object_state", state(spark, (7, 0))).count())
        s.commit(n, {"object_state": state(spark, (7, n))})
    assert len(set(read)) == 1 and read[0] < 400 / store.BUCKETS * 2
    monkeypatch.setattr(store, "ROWS_PER_BUCKET", 10)  # 400 rows need 64 buckets
    s.commit(9, {"object_state": state(spark, (8, 9))})
    assert s.state()[1]["object_state"]["buckets"] == 64
    assert {r["seq"]: r["count"] for r in s.read("object_state").groupBy("seq").count().collect()} == {0: 398, 4: 1, 9: 1}


def test_reads_by_month(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for n in range(6):
        s.commit(n, {"facts": facts(spark, n, at=datetime(2024, 1 + n, 15))})
    df = s.read("facts", datetime(2024, 2, 20), datetime(2024, 5, 1))
    assert values(df) == ["2", "3"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan.replace("#", "") or "month" in plan.split("PartitionFilters: ")[1].split("]")[0]
    files = spark.read.parquet(f"{tmp_path}/facts").inputFiles()
    assert len([f for f in df.inputFiles() if "month=2024-0" in f]) >= 4 and len(files) >= 6


def row(name, kind="MODIFIED", minute=0, doc="{}", outcome=filters.KEEP, version="1"):
    return ("c1", f"c1/{name}", "pods", "Pod", "shop", name, T0 + timedelta(minutes=minute), kind, version, doc, outcome)


RAW = "cluster_id string, object_id string, resource string, kind string, namespace string, name string, observed_at timestamp, observation_type string, resource_version string, raw string, outcome string"


def test_raw_latest(spark, tmp_path):
    """Upserts, deletions and objects that come again, over two batches; a discarded change counts, a discarded resource and a row without a name don't."""
    s = Store(spark, str(tmp_path))
    first = [row("a", doc="a1"), row("b", doc="b1"), row("c", doc="c1"), row("d", "DELETED", 1), row("e", doc="e1", outcome=filters.DISCARD_RESOURCE), row("", doc="n")]
    second = [row("a", minute=5, doc="a2", outcome=filters.DISCARD_CHANGE), row("b", "DELETED", 6), row("d", "ADDED", 7, "d2"), row("f", minute=8, doc="9", version="9"), row("f", minute=8, doc="10", version="10")]
    for n, rows in enumerate((first, second)):
        s.commit(n, {"latest_raw": raw_updates(spark.createDataFrame(rows, RAW))})
    assert {r["name"]: r["doc"] for r in s.read("latest_raw").collect()} == {"a": "a2", "c": "c1", "d": "d2", "f": "10"}


def test_ingest_works_once(spark, tmp_path):
    """Filters and extraction run while rows are staged; no table's plan has them again. All tables are stored and secrets aren't."""
    secret = {"apiVersion": "v1", "kind": "Secret", "metadata": {"name": "s", "namespace": "shop", "uid": "u-s", "resourceVersion": "3", "managedFields": [{"manager": "m"}]}, "data": {"k": "aHVzaA=="}}
    staged = {}

    def stage(df, name):
        staged[name] = df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
        df.write.parquet(f"{tmp_path}/staged/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/staged/{name}")

    tables = ingest(rows_of(spark, [pod("a", "1"), secret]), stage=stage)
    assert set(staged) == {"filtered", "evidence"} and all(staged.values())
    for name, df in tables.items():
        assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString(), name
    root = f"{tmp_path}/out"
    assert collect.ingest_batch(spark, root, 0, rows_of(spark, [pod("a", "1"), secret]), collect.offset_rows(rows_of(spark, [pod("a", "1")]), "watch"))
    assert not collect.ingest_batch(spark, root, 0, rows_of(spark, [pod("b", "1")]), collect.offset_rows(rows_of(spark, [pod("b", "1")]), "watch"))
    s = Store(spark, root)
    assert {r["name"] for r in s.read("latest_raw").collect()} == {"a", "s"} and s.read("filter_rollup").count() > 0 and s.read("facts").count() > 0
    kept = [p.read_bytes() for p in (tmp_path / "out").rglob("*.parquet")] + [json.dumps([r.asDict() for t in ("latest_raw", "versions") for r in s.read(t).collect()], default=str).encode()]
    assert not any(b"aHVzaA" in x for x in kept) and not (tmp_path / "out/_staged").exists() or not list((tmp_path / "out/_staged").iterdir())


def test_offset_ties(spark):
    o = collect.offset_rows(rows_of(spark, [pod("a", "9")]), "watch").unionByName(collect.offset_rows(rows_of(spark, [pod("a", "10")]), "watch"))
    assert [r["resource_version"] for r in sinks.coalesced_offsets(o).collect()] == ["10"]


def test_malformed_definitions(spark):
    from lorebase.sources.resolver import Resolver

    docs = ["{", "[]", "null", '{"spec": 1}', '{"spec": {"group": "g", "names": {"kind": "Thing"}, "versions": [{"name": "v1"}, {"name": "v2", "storage": true}], "scope": "Cluster"}}']
    r = Resolver().with_crds(spark.createDataFrame([(d,) for d in docs], "doc string")).by_kind("g", "Thing")
    assert (r.version, r.resource, r.namespaced) == ("v2", "things", False)

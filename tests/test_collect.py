"""List, watch and what follows from their offsets."""

import json
from datetime import datetime, timedelta

import pytest
from lorebase.operators import versions
from lorebase.plans import collect
from lorebase.plans.recipes import page_after
from lorebase.schema import empty
from lorebase.sources.documents import observations
from lorebase.sources.sinks import read_table
from pyspark.sql import functions as F

T0 = datetime(2024, 5, 1)


def pod(name, version, phase="Running"):
    return {"apiVersion": "v1", "kind": "Pod", "metadata": {"name": name, "namespace": "shop", "uid": f"u-{name}", "resourceVersion": version}, "status": {"phase": phase}}


def rows_of(spark, docs, at=T0):
    return observations(spark.createDataFrame([("c1", at, "ADDED", json.dumps(d)) for d in docs], "cluster_id string, observed_at timestamp, observation_type string, doc string"))


def streams_of(spark, version="5"):
    return spark.createDataFrame([("c1", "", "pods", "v1", "Pod", True, version)], "cluster_id string, api_group string, resource string, api_version string, kind string, namespaced boolean, resource_version string")


def feed(path, name, events):
    """A file of watch events of two streams, as a fake source would send them."""
    lines = [json.dumps({"cluster_id": "c1", "observed_at": (T0 + timedelta(minutes=m)).isoformat(), "value": json.dumps({"type": t, "object": d})}) for m, t, d in events]
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(lines))


def test_list_tells_deletions(spark):
    before = rows_of(spark, [pod("a", "1"), pod("b", "2")])
    rows, offsets = collect.list_once(streams_of(spark), rows_of(spark, [pod("a", "3")]), before, T0 + timedelta(hours=1))
    assert {(r["name"], r["observation_type"]) for r in rows.collect()} == {("a", "ADDED"), ("b", "DELETED")}
    o = offsets.first()
    assert (o["event"], o["resource_version"], o["last_list_at"], o["last_watch_at"]) == ("listed", "5", T0 + timedelta(hours=1), None)
    # a stream whose list is empty has no objects left, and a stream that wasn't listed keeps its own
    nothing = rows_of(spark, [pod("a", "3")]).where("false")
    assert collect.list_once(streams_of(spark), nothing, before, T0)[0].count() == 2
    assert collect.list_once(streams_of(spark).where("false"), nothing, before, T0)[0].count() == 0


def test_list_then_watch(spark, tmp_path):
    root, events = str(tmp_path / "out"), tmp_path / "events"
    node = {"apiVersion": "v1", "kind": "Node", "metadata": {"name": "n1", "uid": "n", "resourceVersion": "9"}}
    feed(events, "1.json", [(1, "MODIFIED", pod("a", "6", "Failed")), (2, "ADDED", node), (3, "BOOKMARK", pod("", "20"))])
    run = lambda: collect.list_then_watch(spark, root, streams_of(spark), rows_of(spark, [pod("a", "1"), pod("b", "2")]), str(events), T0)
    run()
    v = read_table(spark, root, "versions")
    assert {(r["name"], r["seq"]) for r in v.collect()} == {("a", 1), ("a", 2), ("b", 1), ("n1", 1)}
    assert read_table(spark, root, "observations").where("name = ''").count() == 0
    offsets = read_table(spark, root, "ingestion_offsets")
    assert {(r["resource"], r["event"], r["resource_version"]) for r in offsets.collect()} == {("pods", "listed", "5"), ("pods", "watch", "6"), ("nodes", "watch", "9"), ("pods", "bookmark", "20")}
    assert {(r["resource"], r["next"], r["resource_version"]) for r in collect.resume_points(offsets).collect()} == {("pods", "watch", "20"), ("nodes", "watch", "9")}
    feed(events, "2.json", [(4, "MODIFIED", pod("a", "21", "Failed")), (5, "DELETED", pod("b", "22"))])
    run()
    # an unchanged document is no version, a deletion is one, and the list isn't taken again
    assert {(r["name"], r["seq"]) for r in read_table(spark, root, "versions").collect()} == {("a", 1), ("a", 2), ("b", 1), ("b", 2), ("n1", 1)}
    assert read_table(spark, root, "observations").count() == 6


@pytest.mark.parametrize("error,status,step", [("too old resource version", "retrying", "list"), ("HTTP2: stream closed", "retrying", "watch"), ("forbidden", "watch_error", "watch")])
def test_failures(spark, error, status, step):
    offsets = collect.offset_rows(rows_of(spark, [pod("a", "9"), pod("b", "10")]), "watch")
    e = spark.createDataFrame([("c1", "", "pods", "", error, T0 + timedelta(minutes=1)), ("c1", "", "unknown", "", error, T0)], "cluster_id string, api_group string, resource string, namespace string, error string, updated_at timestamp")
    failed = collect.watch_failures(offsets, e)
    assert [(r["status"], r["error"], r["resource_version"]) for r in failed.collect()] == [(status, error, "10")]
    (r,) = collect.resume_points(offsets.unionByName(failed)).collect()
    assert (r["next"], r["resource_version"]) == (step, "" if step == "list" else "10")
    assert versions.merged_offsets(offsets.unionByName(failed)).first()["status"] == status


def test_ingest_of_files(spark, tmp_path):
    for cluster, docs in (("east", [pod("a", "1")]), ("west", [pod("b", "2"), pod("c", "3")])):
        (tmp_path / cluster).mkdir()
        (tmp_path / cluster / "pods.json").write_text(json.dumps({"items": docs}))
    t = collect.ingest_path(spark, str(tmp_path), cluster_part=1, observed_at=T0)
    assert {(r["cluster_id"], r["name"]) for r in t["versions"].collect()} == {("east", "a"), ("west", "b"), ("west", "c")}
    assert collect.ingest_path(spark, str(tmp_path / "east" / "pods.json"), "x", observed_at=T0)["versions"].first()["cluster_id"] == "x"


def test_pages(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), ("b", None)], "k string, n int")
    seen, after = [], None
    while page := page_after(df, ["k", "n"], after, 2).collect():
        seen += [tuple(r) for r in page]
        after = seen[-1]
    assert seen == [(None, 1), ("a", 1), ("a", 2), ("b", None), ("b", 1)]
    assert page_after(df.where("false"), ["k", "n"], None, 2).count() == 0


def test_no_offsets_of_no_rows(spark):
    assert collect.offset_rows(empty(spark, "observations"), "watch").count() == 0
    assert collect.resume_points(empty(spark, "ingestion_offsets").where(F.lit(True))).count() == 0

"""As-of joins, percentiles, trigram search and graph search against brute force, hot keys among them."""

import math
import random
from datetime import datetime, timedelta

import pytest
from lorebase.operators import graph, quantiles, trigrams
from lorebase.operators.asof import newest_within
from pyspark.sql import functions as F

T0 = datetime(2024, 3, 1)
EVENTS, ROWS = "k string, g int, ts timestamp, note string", "k string, g int, observed_at timestamp, doc string, ok boolean"


def minutes(n):
    return T0 + timedelta(minutes=n)


@pytest.mark.parametrize("stretch", [60, 3600, 10**7])
def test_newest_within(spark, stretch):
    r = random.Random(stretch)
    key = lambda: (r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice([1, 2, None]))
    events = [(*key(), r.choice([None, minutes(r.randint(0, 300))]) if r.random() < 0.1 else minutes(r.randint(0, 300)), r.choice(["x", None])) for _ in range(120)] * 2
    rows = [(*key(), None if r.random() < 0.05 else minutes(r.randint(-100, 400)), r.choice([None, *"pqrs"]), r.random() < 0.6) for _ in range(500)]
    out = newest_within(spark.createDataFrame(events, EVENTS), spark.createDataFrame(rows, ROWS), ["k", "g"], "doc", before_s=1800, after_s=3600, keep=F.col("ok"), stretch_s=stretch)
    want = {}
    for e in set(events):
        near = [x for x in rows if None not in (e[0], e[1], e[2], x[2]) and x[:2] == e[:2] and e[2] - timedelta(minutes=30) <= x[2] <= e[2] + timedelta(minutes=60)]
        kept = [x for x in near if x[4]]
        best = max((x[2] for x in kept), default=None)
        values = [x[3] for x in kept if x[2] == best]
        want[e] = (max((v for v in values if v is not None), default=None) if kept else None, len(near) * events.count(e))
    got = {(x["k"], x["g"], x["ts"], x["note"]): (x["enriched"], x["candidates"]) for x in out.collect()}
    assert got == want and out.count() == len(want)


def test_a_hot_key_is_many_groups(spark):
    """One key's 3000 rows and events: no step makes pairs, and the largest group is a stretch of time."""
    times = spark.range(3000).select(F.lit("hot").alias("k"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(mins=F.col("id"))).alias("t"))
    out = newest_within(times.select("k", F.col("t").alias("ts")), times.select("k", F.col("t").alias("observed_at"), F.col("t").cast("string").alias("doc")), ["k"], "doc")
    assert out.agg(F.sum("candidates")).first()[0] == sum(min(i, 30) + 1 + min(2999 - i, 60) for i in range(3000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("bins, last", [(4, 3), (4096, 50_000)])
def test_nearest_rank(spark, bins, last):
    r = random.Random(bins)
    pool = [0.0, -1.5, 1e308, -1e308, 5e-324, 7.25, float("inf"), float("-inf"), float("nan"), None]
    data = [(r.choice(["a", None]), r.choice(pool)) for _ in range(200)] + [("hot", float(r.randint(0, 60)) ** 5) for _ in range(400)] + [("one", 3.0)] * 50 + [("none", None)]
    qs = [0.0, 0.01, 0.5, 0.9, 1.0]
    out = quantiles.nearest_rank(spark.createDataFrame(data, "g string, v double"), ["g"], "v", qs, bins, last).collect()
    want = {}
    for g in {x[0] for x in data}:
        vs = sorted((v for h, v in data if h == g and v is not None), key=lambda v: (math.isnan(v), v))
        want |= {(g, q): (len(vs), str(vs[max(1, math.ceil(q * len(vs))) - 1])) for q in qs if vs}
    assert {(x["g"], x["quantile"]): (x["n"], str(x["value"])) for x in out} == want
    longs = spark.range(1000).select((F.col("id") + (1 << 53)).alias("v"))  # neighbours that are one double
    assert quantiles.nearest_rank(longs, [], "v", [0.25], bins, last).first()["value"] == (1 << 53) + 249


def test_trigrams(spark, tmp_path):
    r = random.Random(2)
    texts = [None, "", "ab", "ABC", "xabcx", "日本語です", "ÉCOLE école", "a b  c\nd", "x" * 40_000 + "needle" + "y" * 40_000, *("".join(r.choice("abcé ") for _ in range(r.randint(0, 30))) for _ in range(80))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    index = trigrams.TextIndex.build(df, ("id",), F.col("t"), str(tmp_path / "i"))
    for terms in (["abc"], ["ABC", "bca"], ["ab"], ["ab", "abc é"], ["本語で"], ["école"], ["needle"], ["xyyyy"], ["zzz"], [], ["c\nd"], ["xneedley"]):
        want = {i for i, t in enumerate(texts) if t is not None and all(w.lower() in t.lower() for w in terms)} if terms else set(range(len(texts)))
        assert {x["id"] for x in index.search(df, F.col("t"), terms).collect()} == want, terms
    read = index.search(df, F.col("t"), ["needle"])
    assert "PartitionFilters: [bucket" in read._jdf.queryExecution().executedPlan().toString().replace("#", " #").replace("bucket #", "bucket#")
    assert trigrams.TextIndex.build(df.where("false"), ("id",), F.col("t"), str(tmp_path / "none")).search(df, F.col("t"), ["abc"]).count() == 0


EDGE = "cluster_id string, edge_type string, src_id string, dst_id string, src_kind string, dst_kind string, valid_from timestamp, valid_to timestamp"


def edge(kind, src, dst, minute):
    return ("c", kind, src, dst, "", "", minutes(minute), None)


def by_hand(edges, roots, limit, rounds):
    found, reached = set(), set(roots)
    for _ in range(rounds):
        near = sorted((e for e in set(edges) if e[2] in reached or e[3] in reached), key=lambda e: (-e[6].timestamp(), e[1], e[2], e[3]))[:limit]
        found |= set(near)
        now = reached | {x for e in found for x in e[2:4]}
        if now == reached:
            break
        reached = now
    return {e[1:4] for e in found}


def test_graph_search(spark, tmp_path):
    r = random.Random(9)
    edges = [edge(r.choice("uv"), f"n{r.randint(0, 40)}", f"n{r.randint(0, 40)}", r.randint(0, 500)) for _ in range(150)] + [edge("hub", "hub", f"n{i}", i) for i in range(41)]
    g = graph.Adjacency.build(spark.createDataFrame(edges, EDGE), str(tmp_path / "g"), 8)
    for roots in (["n1"], ["hub"], ["n1", "n2"], ["absent"]):
        for limit, rounds in ((3, 3), (20, 2), (1000, 9)):
            assert {tuple(x) for x in graph.search_edges(g, roots, limit, rounds).select("edge_type", "src_id", "dst_id").collect()} == by_hand(edges, roots, limit, rounds)
    plan = g.touching(["n1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(g.touching(["n1"]).select(F.input_file_name()).distinct().collect()) < len(spark.read.parquet(str(tmp_path / "g")).inputFiles())


def test_canonical_ends(spark, tmp_path):
    """A pod that one edge knows by path and another by uid is one node; kinds come from the aliases."""
    edges = [edge("targets", "slice", "c/pods/shop/a", 1), edge("runs_on", "c/u-a", "c/nodes/n", 2), edge("other", "x", "y", 3)]
    aliases = spark.createDataFrame([("c", "c/u-a", "c/pods/shop/a", "Pod"), ("c", "c/u-a", "c/u-a", "Pod")], "cluster_id string, object_id string, alias_id string, kind string")
    g = graph.Adjacency.build(spark.createDataFrame(edges, EDGE), str(tmp_path / "g"), 4)
    found = graph.search_edges(g, ["slice"], aliases=aliases)
    assert {(x["src_id"], x["dst_id"], x["dst_kind"]) for x in found.collect()} == {("slice", "c/u-a", "Pod"), ("c/u-a", "c/nodes/n", "")}
    nothing = graph.Adjacency.build(spark.createDataFrame([], EDGE), str(tmp_path / "none"))
    assert graph.search_edges(nothing, ["slice"], aliases=aliases).count() == 0
    assert graph.search_edges(g, ["slice"], limit=0, aliases=aliases, start=minutes(3)).count() == 2  # open edges go on


def test_service_evidence(spark, tmp_path):
    seen = "cluster_id string, object_id string, kind string, namespace string, name string, uid string, observed_at timestamp"
    objects = [("c", "svc", "Service", "shop", "web", "u"), ("c", "slice", "EndpointSlice", "shop", "web-1", "u1"), ("c", "pod", "Pod", "shop", "web-0", "u2"), ("c", "far", "Pod", "x", "far", "u3")]
    versions = spark.createDataFrame([(*o, minutes(i)) for i, o in enumerate(objects)], seen)
    facts = spark.createDataFrame([(o[0], o[1], o[2], o[3], o[4], "k", str(i), 20 + i, minutes(i)) for i, o in enumerate(objects) for _ in range(2)], "cluster_id string, object_id string, kind string, namespace string, name string, fact_key string, fact_value string, severity int, ts timestamp")
    changes = facts.selectExpr("ts", "cluster_id", "object_id", "kind", "namespace", "name", "'status' change_family", "'p' path", "'replace' op", "'' old_scalar", "fact_value new_scalar", "severity")
    g = graph.Adjacency.build(spark.createDataFrame([edge("endpointslice_for_service", "slice", "svc", 1), edge("endpointslice_targets_pod", "slice", "pod", 2), edge("a", "far", "farther", 3)], EDGE), str(tmp_path / "g"))
    out = graph.service_evidence({"versions": versions, "facts": facts, "changes": changes}, g, "shop", "web", limit=5)
    assert tuple(out["summary"].first()) == (1, 3, 5, 2, 5)
    assert [x["object_id"] for x in out["objects"].collect()] == ["pod", "slice", "svc"] and out["facts"].first()["object_id"] == "pod"
    assert tuple(graph.service_evidence({"versions": versions, "facts": facts, "changes": changes}, g, "shop", "none")["summary"].first()) == (0, 0, 0, 0, 0)
    with pytest.raises(ValueError, match="namespace and name"):
        graph.service_evidence({}, g, "", "web")

"""What larger and odd tables showed: times before 1970, and plans whose tasks don't grow with the tables."""

import json

import duckdb
import pytest
from lorebase.plans.queries import ORACLE_SQL, QUERIES
from lorebase.sources import shared

SF = "/root/testdata/sf0.001"


def test_bucket_div_before_1970(spark, tmp_path):
    times = ["1969-12-31 23:30:00", "1969-12-31 23:00:00", "1969-12-31 23:00:00.0005", "1969-12-31 22:59:59.9995", "1969-12-31 23:59:59.9995", "1900-02-03 04:05:06", "1970-01-01 00:30:00", "0001-01-01 00:00:00", "9999-12-31 23:59:59"]
    db = duckdb.connect()
    db.sql(f"COPY (SELECT CAST(unnest({times} || [NULL]) AS TIMESTAMP) AS ts) TO '{tmp_path}/events.parquet'")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES["bucket_div"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, db.sql(ORACLE_SQL["bucket_div"]).fetchall()))


def test_bucket_div_rounds_to_milliseconds(spark, tmp_path):
    """Times less than half a millisecond before an hour go to it, on both sides of 1970; halves go away from zero."""
    db = duckdb.connect()
    db.sql(f"COPY (SELECT make_timestamp(CAST(h * 3600000000 + u AS BIGINT)) AS ts FROM range(-3, 4) a(h), (SELECT unnest([-1500, -1000, -999, -501, -500, -499, -1, 0, 1, 499, 500, 501, 999, 1000, 1500]) AS u)) TO '{tmp_path}/events.parquet'")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES["bucket_div"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(ORACLE_SQL["bucket_div"]).fetchall())


@pytest.mark.parametrize("name", ["t27_service_topology", "distinct_union", "t4_allocation", "evidence_score", "evidence_score_all", "t28_overview"])
def test_tasks_by_rows(spark, monkeypatch, name):
    """Joins and windows are dealt over as many tasks as their rows ask for, also if the session has few, with the SQL's rows."""
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 60)
    out = QUERIES[name](spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    db = duckdb.connect()
    for t in ("events", "orders", "lineitem", "customer", "nation"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = {t: db.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] // 60 for t in ("events", "lineitem")}
    assert any(f", {n})" in plan and "REPARTITION_BY_NUM" in plan for n in (rows["events"], rows["lineitem"]))
    want = db.sql(ORACLE_SQL[name])
    assert sorted(map(str, map(tuple, out.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_trigram_postings_are_gathered(spark, tmp_path):
    """A gram has a row for each part of the table, not for each text; long texts and marks beyond 16 bits are found."""
    from lorebase.operators.trigrams import PIECE, TextIndex
    from pyspark.sql import functions as F

    rows = spark.range(500).select("id", F.when(F.col("id") == 7, F.concat(F.repeat(F.lit("x"), PIECE - 4), F.lit("End \U0001f600 of it"))).when(F.col("id") == 8, F.lit(None)).otherwise("some words").alias("t"))
    index = TextIndex.build(rows, ("id",), F.col("t"), f"{tmp_path}/index")
    assert index._postings().where("gram = 'wor'").count() <= 2 * spark.sparkContext.defaultParallelism
    assert index._postings().agg(F.sum("n")).first()[0] > 498 * 8
    assert [r["id"] for r in index.search(rows, F.col("t"), ["end \U0001f600 of"]).collect()] == [7]
    assert index.search(rows, F.col("t"), ["some", "WORDS"]).count() == 498


def test_items_are_made_in_slices(spark, monkeypatch):
    """A batch's documents become items a few at a time, in their order, with nothing lost at the edges of a slice."""
    import json

    from lorebase.operators import extract
    from pyspark.sql import functions as F

    assert extract.DOCS <= 500
    doc = F.to_json(F.struct(F.struct(F.concat(F.lit("n-"), F.col("id")).alias("nodeName")).alias("spec")))
    rows = spark.range(0, 1203, 1, 1).select("id", F.when(F.col("id") != 500, doc).alias("doc"), F.lit("Pod").alias("kind"))
    found = {r["id"]: r["items"] for r in extract.with_items(rows).select("id", "items").collect()}
    assert len(found) == 1203 and found[500] == []
    assert all(x[0]["strings"] == {"spec.nodeName": f"n-{i}"} for i, x in found.items() if i != 500), json.dumps(str(found[0]))


@pytest.mark.parametrize("name", ["extract_pod_edges", "extract_pod_facts"])
def test_documents_are_parsed_once(spark, monkeypatch, name):
    """A document's items are made once, in tasks that its table's rows ask for, with the SQL's rows."""
    monkeypatch.setattr(shared, "DOCS_PER_TASK", 60)
    out = QUERIES[name](spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [run(") == 1
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    assert f", {db.sql('SELECT count(*) FROM orders').fetchall()[0][0] // 60})" in plan and "REPARTITION_BY_NUM" in plan
    want = db.sql(ORACLE_SQL[name])
    assert sorted(map(str, map(tuple, out.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_items_hold_what_is_read_alone():
    """Keys with dots and brackets, scalars in lists, lists in lists, members of the wrong type."""
    from lorebase.operators import extract

    service = {"metadata": {"labels": {"kubernetes.io/service-name": "web", "other": "x"}, "managedFields": [{"deep": {"er": 1}}]}, "endpoints": [{"conditions": {"ready": True, "serving": 1}, "targetRef": {"kind": "Pod", "name": "p"}}, None, "text", [1]]}
    items = extract.items_of(json.dumps(service), "EndpointSlice")
    assert [x["path"] for x in items] == ["", "endpoints[*]", "endpoints[*]", "endpoints[*]"]
    assert items[0]["strings"] == {"metadata.labels.kubernetes~.io/service-name": "web"} and items[0]["flags"] == {"endpoints[*]": True}
    assert items[1]["strings"] == {"targetRef.kind": "Pod", "targetRef.name": "p"} and items[1]["flags"] == {"conditions.ready": True} and items[1]["numbers"] == {"conditions.serving": 1.0}
    found = extract._items_array(["{", None, '{"spec": {"nodeName": "n"}}'], ["Pod"] * 3).to_pylist()
    assert [len(x) for x in found] == [0, 0, 1] and found[2][0] == {"path": "", "strings": [("spec.nodeName", "n")], "numbers": [], "flags": []}


def test_layout_of_edges_is_written_in_turns(spark, tmp_path, monkeypatch):
    """A share of the edges is shuffled at a time, a row holds each id once, and every edge is found by both ends."""
    from lorebase.operators import graph
    from pyspark.sql import functions as F

    monkeypatch.setattr(graph, "EDGES_PER_TURN", 5_000, raising=False)
    ident = lambda c: F.sha2(c.cast("string"), 256)
    src, dst = ident(F.col("id")), F.when(F.col("id") % 4 == 0, "hub").otherwise(ident(-F.col("id")))
    edges = spark.range(20_000).select(F.lit("c").alias("cluster_id"), F.lit("t").alias("edge_type"), src.alias("src_id"), dst.alias("dst_id"), F.lit("k").alias("src_kind"), F.lit("k").alias("dst_kind"), F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    jvm, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(x := got.apply(i)).stageId(): x.shuffleWriteRecords() for got in [store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)] for i in range(got.size())}
    before = set(stages())
    g = graph.Adjacency.build(edges, str(tmp_path / "g"), rows=20_000)
    written = [n for i, n in stages().items() if i not in before]
    assert sum(written) == 40_000 and max(written) < 10_000  # nearly a quarter of the edges hang on one id
    assert sum(f.stat().st_size for f in (tmp_path / "g").rglob("*.parquet")) < 20_000 * 4 * 40  # an id has 64 hex digits
    assert g.touching(["hub"]).where("direction = 'in' AND dst_id = 'hub'").select("src_id").distinct().count() == 5_000
    some = edges.where("dst_id <> 'hub'").orderBy("src_id").limit(20).collect()
    for near, way in (("src_id", "out"), ("dst_id", "in")):
        found = g.touching([x[near] for x in some]).where(F.col("direction") == way).select(*edges.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, some))
    assert graph.search_edges(g, [some[0]["src_id"]], rounds=2).select("src_id", "dst_id").collect() == [(some[0]["src_id"], some[0]["dst_id"])]

"""Queries that work on all that their operators give, against plain Python over the same tables."""

import random
from collections import Counter

import duckdb
import pytest
from lorebase.plans import recipes
from lorebase.plans.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_scores_count_edges(spark):
    want = Counter()
    last = {}
    for user, kind in duckdb.sql(f"SELECT user_id, event_type FROM '{SF}/events.parquet' ORDER BY ts, event_id").fetchall():
        want[f"c1/{user}"] += 20 + 15 * (last.get(user, "") != kind)
        last[user] = kind
    for table, key, kind, edges in (("lineitem", "l_orderkey", "order", 2), ("orders", "o_custkey", "customer", 1), ("customer", "c_custkey", "customer", 1), ("nation", "n_nationkey", "nation", 1)):
        for (k,) in duckdb.sql(f"SELECT {key} FROM '{SF}/{table}.parquet'").fetchall():
            want[f"{kind}/{k}"] += 10 * edges
    got = {r["object_id"]: r["score"] for r in QUERIES["evidence_score_all"](spark, SF).collect()}
    assert got == dict(want)


def test_version_diffs_give_every_change(spark, tmp_path):
    docs = ['{"a": 1, "b": 1, "c": 1}', '{"a": 2, "b": 2, "d": 1}', '{"a": 2, "b": 2, "d": 1}', '{"a": 3, "b": 2, "d": 1}']
    rows = ", ".join(f"({i}, 1, TIMESTAMP '2024-01-01' + INTERVAL {i} HOUR, '{kind}', '{doc}', 0.0)" for i, (doc, kind) in enumerate(zip(docs, ["signup", "error", "click", "click"], strict=True)))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) AS t(event_id, user_id, ts, event_type, props, value)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = sorted((r["seq"], r["path"] or "", r["truncated"]) for r in QUERIES["r10_version_diffs"](spark, str(tmp_path)).collect())
    assert got == [(2, "/a", False), (2, "/b", False), (2, "/c", False), (2, "/d", False), (3, "", False), (4, "/a", False)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_peak_is_swept_by_minute(spark, kind):
    r = random.Random(3)
    rows = [(r.choice(["c1", "c2", None]), a := r.randrange(20_000), a + r.randrange(1, 4000) if r.random() < 0.8 else None) for _ in range(500)]
    df = spark.createDataFrame(rows, "cluster_id string, a long, b long").select("cluster_id", *(F.timestamp_seconds(c).cast(kind).alias(n) for c, n in (("a", "interval_start"), ("b", "interval_end"))))
    want = {}
    for c in ("c1", "c2", None):
        mine = [x for x in rows if x[0] == c]
        want[c] = max(sum(a <= t and (b is None or b > t) for _, a, b in mine) for _, t, _ in mine)
    peak = recipes.presence_peak(df)
    assert {x["cluster_id"]: x["peak"] for x in peak.collect()} == want
    by_time = [x for x in peak._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x and "[t#" in x]
    assert by_time and all("minute#" in x.rsplit("], [t#", 1)[0].rsplit("[", 1)[1] for x in by_time)


def test_pairs_are_counted_not_made(spark, tmp_path):
    n = 300_000  # 9 x 10^10 pairs
    duckdb.sql(f"""COPY (SELECT i AS event_id, 1 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, CASE WHEN i < {n} THEN 'error' ELSE 'click' END AS event_type, '{{"k": 7}}' AS props, 0.0 AS value FROM range({n} + 10) AS t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    paired = QUERIES["paired_facts"](spark, str(tmp_path))
    plan = paired._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("Join")
    assert {r["value"]: (r["rows"], r["objects"]) for r in paired.collect()} == {"event.error": (n * n, 1), "event.click": (10 * n, 1)}

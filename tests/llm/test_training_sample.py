"""What operator 1 is fitted on: whole texts, and only rows that can be learned from."""

import zlib

from lorebase.llm import quality_crf
from pyspark.sql import functions as F


def _docs(spark, n):
    ids = [i for i in range(20 * n) if zlib.crc32(str(i).encode()) % 3 != 1][:n]
    text = lambda i: "a calm line of plain words here\n" * 60 + ("#### $$$$ !!!! &&&& %%%%\n" * 60 if i % 2 else "")
    return spark.createDataFrame([(i, text(k)) for k, i in enumerate(ids)], "doc_id long, text string"), [(i, 1 - k % 2) for k, i in enumerate(ids)]


def test_whole_texts(spark):
    docs, labels = _docs(spark, 60)
    truth = dict(labels)
    rows = quality_crf.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r["predicted"] == truth[r["doc_id"]] for r in rows)


def test_rows_without_use_take_no_place(spark, monkeypatch):
    monkeypatch.setattr(quality_crf, "SAMPLE", 20)
    docs, labels = _docs(spark, 60)
    useless = [(i, None) for i in range(10_000, 10_400)] + [(i, 1) for i in range(20_000, 20_400)]
    scored = quality_crf.quality_scores(docs, spark.createDataFrame(labels + useless, "doc_id long, quality int"))
    assert {r["score"] for r in scored.collect()} != {0.5}


def test_a_rare_class_is_in(spark, monkeypatch):
    monkeypatch.setattr(quality_crf, "SAMPLE", 10)
    rows = spark.range(200).select(F.col("id").alias("_id"), (F.col("id") < 2).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in quality_crf._sampled(rows, "label", "_id").groupBy("label").count().collect()}
    assert counts == {0: 8, 1: 2}

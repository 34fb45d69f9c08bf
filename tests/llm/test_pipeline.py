"""Each stage of the pipeline does to its input what the operator's brute-force version says; decisions take effect."""

import corpus_pipeline
from lorebase.llm import mixing, near_dedup, quality_rules
from threading import Thread

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        outs[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    before, after = outs["quality rules"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in quality_rules.quality_report(before).where("kept").collect()}
    before, after = outs["line dedup"]
    assert 0 < after.count() <= before.count() and after.where(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).count() == 0
    before, after = outs["near dedup"]
    assert {r["doc_id"] for r in after.collect()} == {r["class_id"] for r in near_dedup.near_duplicates(before).collect()}
    before, after = outs["mixing"]
    size = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert size(after) == mixing.mix_report(before).agg(F.sum("taken")).first()[0]
    before, after = outs["packing"]
    assert after.where("piece = 0").count() == before.count()


def test_runs_at_once(spark):
    """Two runs of one process neither share nor remove each other's tables, and give the same sequences' tokens."""
    got = {}

    def run(i):
        got[i] = corpus_pipeline.run(spark, SF).agg(F.count("*"), F.sum("length"), F.sum("ids_crc32")).first()

    threads = [Thread(target=run, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got[0] == got[1] and got[0][0] > 0


def test_lazy_composition(spark):
    """Stages called one after the other, with nothing written between them, give what run() gives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    whole = [F.count("*"), F.sum("length"), F.sum("ids_crc32")]
    assert docs.agg(*whole).first() == corpus_pipeline.run(spark, SF).agg(*whole).first()

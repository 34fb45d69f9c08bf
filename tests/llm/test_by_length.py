"""Word limits that follow length: a long text just under the fixed limit goes, label-1 documents stay."""

import random

from lorebase.llm import quality_rules
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_long_text_under_the_fixed_limit(spark):
    r, common = random.Random(1), quality_rules.COMMON_WORDS["en"]
    text = lambda n, share: " ".join(r.choice(common) if r.random() < share else f"w{r.randrange(10**6)}" for _ in range(n))
    rows = [(i, text(r.choice([60, 120, 400, 2000]), 0.45), "en") for i in range(300)] + [(1000, text(2000, 0.15), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fixed, by_length = ({x["doc_id"]: x for x in quality_rules.quality_report(df, b).collect()} for b in (False, True))
    assert 0.2 < fixed[1000]["word_distance"] < quality_rules.WORD_LIMIT and fixed[1000]["kept"]
    assert not by_length[1000]["kept"] and all(by_length[i]["kept"] for i in range(300))


def test_labelled_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(labels, "doc_id", "left")
    measured = quality_rules.materialize(quality_rules.features(docs, "quality"), "measured")
    rate = lambda b: {x["quality"]: (x["n"], x["k"]) for x in quality_rules.judged(measured, b).where("NOT base_failed AND quality IS NOT NULL").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).collect()}
    fixed, by_length = rate(False), rate(True)
    print(fixed, by_length)
    assert by_length[1][0] == by_length[1][1] and by_length[0][1] < fixed[0][1]

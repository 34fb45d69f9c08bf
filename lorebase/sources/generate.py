"""Volume data from templates: clusters x copies of renamed documents, each with earlier variants."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a template writes where the copy's number belongs.
MARK = "@copy@"


def generate(spark: SparkSession, templates: list[list[dict]], start: datetime, clusters: int = 2, copies: int = 10, step_minutes: int = 5) -> DataFrame:
    """(cluster_id, observed_at, observation_type, doc): each template is an object's documents over time. Rows are made on the executors; the same arguments give the same rows."""
    rows = [(t, i, json.dumps(doc)) for t, states in enumerate(templates) for i, doc in enumerate(states)]
    docs = F.broadcast(spark.createDataFrame(rows, "template int, state int, doc string"))
    places = spark.range(clusters * copies).select((F.col("id") % clusters).alias("c"), F.expr(f"id div {clusters}").alias("copy"))
    at = F.lit(start).cast("timestamp") + F.make_dt_interval(mins=F.col("state") * step_minutes)
    return places.crossJoin(docs).select(F.concat(F.lit("cluster-"), "c").alias("cluster_id"), at.alias("observed_at"), F.when(F.col("state") == 0, "ADDED").otherwise("MODIFIED").alias("observation_type"), F.replace("doc", F.lit(MARK), F.col("copy").cast("string")).alias("doc"))

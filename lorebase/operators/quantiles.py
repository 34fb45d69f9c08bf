"""Exact nearest-rank percentiles (A12) by distributed selection.

Equal values of a group are counted first. Then the range of the group's values is cut into bins, the bins' counts are added up, and only the bin that a
rank falls into is looked at again, with its own range, until it has few distinct values; those are sorted. No group is ever in one
task or one buffer: a task sees at most BINS bins or LAST values of a group and rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

BINS, LAST = 4096, 50_000


def _bin(bins: int) -> Column:
    """The bin of x between lo and hi; infinite values and NaN have bins of their own, in order. Halves keep large ranges finite."""
    x, lo, hi = (F.col(c) / 2 for c in ("x", "lo", "hi"))
    inside = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0)) * bins)))
    return F.when(F.isnan("x"), bins + 1).when(F.col("x") == float("inf"), bins).when(F.col("x") == float("-inf"), -1).otherwise(inside).cast("int")


def nearest_rank(df: DataFrame, by: list[str], value: str, quantiles: list[float], bins: int = BINS, last: int = LAST) -> DataFrame:
    """(by..., quantile, n, value): of each group's n values that aren't null the one of rank ceil(quantile * n), at least 1. Null groups are groups; NaN
    is the largest value. A group without values has no rows."""
    group = F.struct(F.lit(0).alias("_"), *by)
    counts = df.where(F.col(value).isNotNull()).groupBy(group.alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    rows = written(counts.withColumns({"x": F.col("v").cast("double"), "path": F.lit("")}), "quantile-counts")
    wanted = rows.groupBy("g").agg(F.sum("n").alias("total")).select("g", "total", F.lit("").alias("path"), F.explode(F.array(*map(F.lit, quantiles))).alias("quantile"))
    wanted = wanted.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("quantile") * F.col("total"))))
    while True:
        finite = F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))
        ranges = rows.groupBy("g", "path").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count("*").alias("values"))
        wide = (F.col("values") > last) & (F.col("hi") > F.col("lo"))
        if not ranges.where(wide).limit(1).count():
            break
        # those with few values stay one bin
        binned = rows.join(ranges, ["g", "path"]).withColumn("bin", F.when(wide, _bin(bins)).otherwise(0))
        sums = binned.groupBy("g", "path", "bin").agg(F.sum("n").alias("in_bin"))
        upto = sums.withColumn("upto", F.sum("in_bin").over(Window.partitionBy("g", "path").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        hit = wanted.join(upto, ["g", "path"]).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("in_bin")))
        deeper = F.concat_ws(".", "path", F.col("bin").cast("string"))
        wanted = written(hit.select("g", "total", deeper.alias("path"), "quantile", (F.col("rank") - F.col("upto") + F.col("in_bin")).alias("rank")), "quantile-ranks")
        rows = written(binned.select("g", "v", "n", "x", deeper.alias("path")).join(wanted.select("g", "path").distinct(), ["g", "path"], "left_semi"), "quantile-counts")
    upto = rows.withColumn("upto", F.sum("n").over(Window.partitionBy("g", "path").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    found = wanted.join(upto, ["g", "path"]).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    return found.select(*(F.col(f"g.{c}").alias(c) for c in by), "quantile", F.col("total").alias("n"), F.col("v").alias("value"))

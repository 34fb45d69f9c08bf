"""As-of joins by running values: for each event the newest row of its keys in a time range around it, and how many rows the range holds.

Events become two marks, where their range begins and where it ends, and are laid among the rows in order of time. A count and the newest kept row
so far, read off at the marks, answer both questions, so the cost is a sort, n log n, however many rows a range or a key has. Keys are cut into
stretches of time, each a group of its own; what lies before a stretch comes from sums by stretch, of which a key has as many as the calendar
allows. A key with a third of all rows is thus many tasks. Rows of one key and one time are merged before anything is dealt out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a stretch in seconds.
STRETCH = 3600
_BEGIN, _ROW, _END = 0, 1, 2


def micros(df: DataFrame, column: str) -> Column:
    """A time, with or without a zone, as microseconds."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_micros(column)
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)")


def newest_within(
    events: DataFrame, rows: DataFrame, keys: list[str], value: str, when: str = "ts", at: str = "observed_at", before_s: int = 1800, after_s: int = 3600, keep: Column | None = None, stretch_s: int = STRETCH
) -> DataFrame:
    """events with enriched, the value of the newest kept row of the keys between before_s seconds before and after_s after (both ends
    inclusive; of one time, the larger value), and candidates, how many rows are there, kept or not. Events that repeat are one row, with their
    candidates added up. Null keys and null times meet nothing."""
    names = events.columns
    null_key = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    marks = events.groupBy(*names).agg(F.count("*").alias("_times"))
    t = micros(events, when)
    ends = F.array(F.struct((t - before_s * 1_000_000).alias("t"), F.lit(_BEGIN).alias("what")), F.struct((t + after_s * 1_000_000).alias("t"), F.lit(_END).alias("what")))
    key = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    probes = marks.where(~null_key & F.col(when).isNotNull()).select(key.alias("key"), F.explode(ends).alias("m"), F.lit(0).cast("long").alias("n"), F.struct("*").alias("event"))

    kept = F.lit(True) if keep is None else keep
    seen = rows.where(~null_key & F.col(at).isNotNull()).select(key.alias("key"), micros(rows, at).alias("t"), F.when(kept, F.struct(F.col(value).alias("value"))).alias("v"))
    merged = seen.groupBy("key", "t").agg(F.count("*").alias("n"), F.max("v").alias("v")).select("key", F.struct("t", F.lit(_ROW).alias("what")).alias("m"), "n", F.when(F.col("v").isNotNull(), F.struct("t", "v")).alias("newest"))

    laid = merged.unionByName(probes, allowMissingColumns=True).withColumn("stretch", F.floor(F.col("m.t") / (stretch_s * 1_000_000)))
    so_far = Window.partitionBy("key", "stretch").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    running = laid.withColumns({"n": F.sum("n").over(so_far), "newest": F.max("newest").over(so_far)}).where(F.col("m.what") != _ROW)
    sums = laid.groupBy("key", "stretch").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("key", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.max("newest").over(earlier).alias("newest_before"))
    read = running.join(carried, ["key", "stretch"]).select("event", "m", (F.col("n") + F.col("n_before")).alias("n"), F.coalesce("newest", "newest_before").alias("newest"))

    of = lambda what, c: F.max(F.when(F.col("m.what") == what, F.col(c)))
    met = read.groupBy("event").agg(of(_BEGIN, "m.t").alias("begin"), of(_END, "newest").alias("newest"), (of(_END, "n") - of(_BEGIN, "n")).alias("n"))
    out = met.select(*(F.col(f"event.{c}").alias(c) for c in names), F.when(F.col("newest.t") >= F.col("begin"), F.col("newest.v.value")).alias("enriched"), (F.col("n") * F.col("event._times")).alias("candidates"))
    alone = marks.where(null_key | F.col(when).isNull()).select(*names, F.lit(None).cast(rows.schema[value].dataType).alias("enriched"), F.lit(0).cast("long").alias("candidates"))
    return out.unionByName(alone)

"""Mixing sources to target weights: hash-random keys, distributed prefix sums, a cut at each source's exact budget.

Each document gets a key, a hash of its id and text, so a source's order is random but the same in every run. Keys are
even over their range, so equal ranges of keys are the range sort: (source, key range) sums are prefix-summed over the
ranges and then within each range, and no task sees a whole source. The number of ranges follows the square root of the
row count, so both the list of ranges and each range stay small. A source is taken whole as many times as its budget
holds it, and the last pass ends inside the document where the budget is used up.

Sizes are words; a null text has none. Sources are ordered by code point, null last, and null is a source like any other.
Rows that are equal in all columns share a key and are taken one after the other. Sources without words have target
0. An empty table gives no rows. Further columns pass through mix() untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

KEY_BITS = 60


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size): one row a source.

    All sizes are shared by weight; a target above cap times its source stops there and the excess is shared again. With
    sources in the order of cap x size / weight, those that stop are the first ones, so running sums find them at once.
    """
    exact = "decimal(38,0)"
    everything, in_order = Window.partitionBy(), Window.orderBy("_ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    multiple = math.lcm(*weights)
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_w", weight.cast(exact)).withColumn("_cap", (F.lit(cap) * F.col("source_size")).cast(exact))
    s = s.withColumn("_ratio", F.col("_cap") * (F.lit(multiple).cast(exact) / F.col("_w")).cast("long"))
    zero = F.lit(0).cast(exact)
    s = s.withColumn("_left", F.sum("source_size").over(everything).cast(exact) - F.coalesce(F.sum("_cap").over(in_order), zero)).withColumn("_w_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(in_order), zero))
    s = s.withColumn("_stops", F.col("_left").cast("decimal(28,0)") * F.col("_w").cast("decimal(10,0)") > F.col("_cap").cast("decimal(28,0)") * F.col("_w_left").cast("decimal(10,0)"))
    rest = F.sum(F.when(F.col("_stops"), -F.col("_cap")).otherwise(zero)).over(everything) + F.sum("source_size").over(everything)
    over = F.sum(F.when(F.col("_stops"), zero).otherwise(F.col("_w"))).over(everything)
    shared = (rest.cast("double") * F.col("_w").cast("double")) / over.cast("double")
    return s.select("source", "source_size", F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(shared).alias("target"))


def taken_words(rows: DataFrame) -> DataFrame:
    """rows (source, size, key, ...) with source_size, target and taken: the words that the mix takes of each row."""
    count = rows.count()
    bits = max(1, min(40, math.ceil(math.log2(max(count, 2)) / 2)))
    ranged = rows.withColumn("_range", F.shiftright("key", KEY_BITS - bits))
    ranges = ranged.groupBy("source", "_range").agg(F.sum("size").alias("size"))
    before_range = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = source_targets(ranges.select("source", "size"))
    base = ranges.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), before_range.alias("_base"))
    base = base.join(targets.select(F.col("source").alias("_t"), "source_size", "target"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    joined = ranged.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).drop("_s", "_r")
    in_range = Window.partitionBy("source", "_range").orderBy("key", F.asc_nulls_last("doc_id")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("size").over(in_range), F.lit(0))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    last = F.greatest(F.lit(0), F.least(F.col("size"), budget - whole * F.col("source_size") - before))
    return joined.withColumn("taken", (whole * F.col("size") + last).cast("long")).drop("_range", "_base")


def _key() -> Column:
    """60 bits of a hash of the id and the text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "text").cast("binary")), 1, 15), 16, 10).cast("long")


def _sized(df: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _key().alias("key"), *more)


def mix_report(df: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document."""
    return taken_words(materialize(_sized(df), "sized")).select("doc_id", "size", "source_size", "target", "taken")


def mix(df: DataFrame) -> DataFrame:
    """The mixed documents, with df's columns: a row for each time a document is taken; the one that the budget ends in is cut after its last word taken. The column n_chars, where there is one, follows the text."""
    whole = df.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    taken = taken_words(materialize(_sized(whole, "_row"), "sized")).where(F.col("taken") > 0)
    passes = F.expr("(taken + size - 1) div size")
    each = taken.withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), passes)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("_pass") - 1) * F.col("size"))
    pieces = F.regexp_extract_all(F.col("_row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(words < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")).otherwise(F.col("_row.text"))
    each = each.withColumn("_text", text)
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return each.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in df.columns))

"""What filters remove one after the other, in every order: how they overlap and what good or toxic text they cost.

Each document becomes one pattern: the set of filters that it fails, as bits. Patterns are counted by part before anything else, so what
follows is small whatever the corpus. A pattern contributes to each edge (filters already applied, next filter) of the subset lattice,
n * 2^(n-1) of them for n filters; an order of the filters is a path of n edges, and each of its steps takes the sums of its edge.

Filters (FILTERS), on the whole text: A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * A-Z characters > 3 * code
points; D: holds any of #$%&*|; E: the text also stands under a smaller id. Texts are told apart by 128-bit digests, words of one text by
64-bit hashes.

Hot texts: copies are counted before any exchange, by (id, text, part), then by (text, part, labels), so a text that a third of all rows
hold is few rows by the time its least id is looked for.

Nulls: a null text is empty (it fails A alone, and E); a null lang is the part ''; a null id is no smaller than any other, has no
labels, and fails E only where a row with an id has the text. Rows that repeat are documents of their own; none of them is smaller than
the other. Of repeated label rows, any that is 1 counts. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .words import column_bytes, slices, spans, word_hashes

#: The filters, by bit, and the characters that D looks for.
FILTERS, SYMBOLS = "ABCDE", b"#$%&*|"
_COPY = 1 << FILTERS.index("E")
_MASKED = "doc_id long, part string, text_key binary, mask int"
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = column_bytes(batch.column("text"))
            start, end, first = spans(data, offsets)
            hashes, n_words = word_hashes(data, start, end), np.diff(first)
            distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)

            def count(what: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(what)])[offsets])

            fails = [n_words < 200, 100 * distinct < 50 * n_words, 100 * count((data >= 65) & (data <= 90)) > 3 * count((data & 0xC0) != 0x80), count(symbol[data]) > 0]
            mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
            keys = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(keys, pa.binary()), pa.array(mask, pa.int32())], names=[x.split()[0] for x in _MASKED.split(", ")])


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by what they fail and how they are labelled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("known"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t")).where("known IS NOT NULL").groupBy("known").agg(F.max("g").alias("good"), F.max("t").alias("toxic"))
    with_id, without = (rows.where(c).mapInArrow(_mask, _MASKED).groupBy("doc_id", "text_key", "part", "mask").agg(F.count("*").alias("c")) for c in ("doc_id IS NOT NULL", "doc_id IS NULL"))
    labelled = with_id.join(known, F.col("doc_id") == F.col("known"), "left").select(with_id.columns + [F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "toxic")])
    labelled = labelled.unionByName(without.withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    groups = labelled.groupBy("text_key", "part", "mask", "good", "toxic").agg(F.sum("c").alias("n"), F.min("doc_id").alias("least"), F.min_by("c", "doc_id").alias("at_least"))
    groups = groups.withColumn("first", F.min("least").over(Window.partitionBy("text_key")))
    stays = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = groups.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", stays.alias("n")), F.struct((F.col("mask") + _COPY).alias("mask"), (F.col("n") - stays).alias("n")))).alias("s"))
    return split.select("part", "s.mask", "good", "toxic", "s.n").where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(found: DataFrame, n_filters: int) -> DataFrame:
    """The sums of each part and lattice edge (applied, bit): applied is the set of filters before, as bits, bit the next filter's."""
    all_edges = [(s, 1 << f) for f in range(n_filters) for s in range(1 << n_filters) if not s >> f & 1]
    at = found.select("part", "mask", "good", "toxic", "n", F.explode(F.array([F.struct(F.lit(s).alias("applied"), F.lit(b).alias("bit")) for s, b in all_edges])).alias("e")).select("part", "mask", "good", "toxic", "n", "e.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("applied")) != 0
    of = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": F.col("mask") == F.col("bit"), "good_lost": fails & ~gone & F.col("good"), "toxic_lost": fails & ~gone & F.col("toxic")}
    return at.groupBy("part", "applied", "bit").agg(*[F.sum(F.when(of[c], F.col("n")).otherwise(0)).alias(c) for c in _COUNTS])


def paths(of_edges: DataFrame, filters: str) -> DataFrame:
    """One row per part, order of the filters and step: the sums of the step's edge; shapley sums removed of the filter over all orders."""
    steps = [("".join(o), i + 1, sum(1 << filters.index(x) for x in o[:i]), 1 << filters.index(o[i])) for o in permutations(filters) for i in range(len(filters))]
    steps_df = of_edges.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, bit int")
    out = of_edges.join(F.broadcast(steps_df), ["applied", "bit"])
    return out.select("part", "filter_order", "step", *_COUNTS, F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""
    return paths(edges(patterns(docs, labels), len(FILTERS)), FILTERS)

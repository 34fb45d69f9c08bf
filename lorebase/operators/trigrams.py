"""Substring search by an inverted index of trigrams (R12, R13): posting tables by gram, intersected, verified by the text itself.

The index has rows (gram, n, entries): the keys of the texts of some part of the table that hold these three characters in lower case, in bucket
folders by the gram's hash and sorted by gram, and a count for each gram. A search reads the postings of the rarest grams of each term, those folders alone, keeps the
keys that have all of them, and looks at these rows only. Terms of fewer than three characters say nothing to the index; with no other term
all rows are looked at. Long texts are cut into overlapping pieces
first, and a row's keys are those of a bounded part, so no array grows with a text or a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a piece of text; grams of a term that are looked up, rarest first; bucket folders.
PIECE, RAREST, BUCKETS = 32_768, 4, 64
#: Characters that a task indexes, and those whose grams it gathers before it hands them on.
TASK, PART = 50_000_000, 4_000_000


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def grams_of(term: str) -> list[str]:
    term = term.lower()
    return sorted({term[i : i + 3] for i in range(len(term) - 2)})


def _gathered(keys: pa.Array, held: list[np.ndarray], at: list[int]) -> pa.RecordBatch:
    """Grams as numbers, by piece, to a row a gram."""
    grams, piece = np.concatenate(held), np.repeat(at, [len(g) for g in held])
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    each, low = grams[starts], (1 << 21) - 1
    chars = np.stack([each >> 42, each >> 21 & low, each & low], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.append(starts, len(grams)).astype(np.int32)
    entries = pa.ListArray.from_arrays(pa.array(ends), keys.take(pa.array(piece[order])))
    return pa.RecordBatch.from_arrays([pa.array([chars[i : i + 3] for i in range(0, len(chars), 3)], pa.string()), pa.array(np.diff(ends)), entries], ["gram", "n", "entries"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n, entries) of (entry, piece of text)."""
    for batch in batches:
        keys, texts = batch.columns
        held, at, chars = [], [], 0
        for i in range(len(texts)):
            c = np.frombuffer(texts[i].as_py().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            if len(c) >= 3:
                held.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
                at.append(i)
                chars += len(c)
            if held and (chars > PART or i == len(texts) - 1):
                yield _gathered(keys, held, at)
                held, at, chars = [], [], 0
        if held:
            yield _gathered(keys, held, at)


@dataclass(frozen=True)
class TextIndex:
    """An index below a folder; keys are the columns that name a row of what it was built from."""

    spark: SparkSession
    folder: str
    keys: tuple[str, ...]
    entry: str

    @staticmethod
    def build(rows: DataFrame, keys: tuple[str, ...], text: Column, folder: str) -> TextIndex:
        """Writes the index of rows; null texts have no grams, rows with equal keys are one entry."""
        entry = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
        types = [f"`{k}`:{rows.schema[k].dataType.simpleString()}" for k in keys]
        index = TextIndex(rows.sparkSession, folder, keys, types[0].partition(":")[2] if len(keys) == 1 else f"struct<{','.join(types)}>")
        cut = rows.select(*keys, F.lower(text).alias("_t")).where("_t IS NOT NULL")
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, (cut.agg(F.sum(F.length("_t"))).first()[0] or 0) // TASK)
        starts = F.sequence(F.lit(1), F.greatest(F.length("_t"), F.lit(1)), F.lit(PIECE - 2))
        piece = cut.repartition(tasks, *keys).select(entry.alias("_k"), F.explode(F.transform(starts, lambda i: F.substr("_t", i, F.lit(PIECE)))).alias("_p"))
        found = piece.mapInArrow(_postings, index._schema())
        found.withColumn("bucket", _bucket(F.col("gram"))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/postings")
        index._postings().groupBy("gram").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/counts")
        return index

    def _schema(self) -> str:
        return f"gram string, n int, entries array<{self.entry}>"

    def _postings(self) -> DataFrame:
        return self.spark.read.schema(f"{self._schema()}, bucket int").parquet(f"{self.folder}/postings")

    def candidates(self, terms: list[str]) -> DataFrame | None:
        """Keys of the rows that have the rarest grams of all terms; None where no term has three characters."""
        asked = {t: grams_of(t) for t in terms if len(t) >= 3}
        if not asked:
            return None
        every = sorted({g for grams in asked.values() for g in grams})
        counts = dict.fromkeys(every, 0) | {r["gram"]: r["n"] for r in self.spark.read.schema("gram string, n bigint").parquet(f"{self.folder}/counts").where(F.col("gram").isin(every)).collect()}  # a row a gram asked for
        chosen = sorted({g for grams in asked.values() for g in sorted(grams, key=lambda g: (counts[g], g))[:RAREST]})
        buckets = [r[0] for r in self.spark.createDataFrame([(g,) for g in chosen], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
        read = self._postings().where(F.col("bucket").isin(buckets) & F.col("gram").isin(chosen))
        entries = read.select("gram", F.explode("entries").alias("_k"))  # the pieces of a text may each have an entry
        held = entries.select("gram", *([F.col("_k").alias(self.keys[0])] if len(self.keys) == 1 else [f"_k.{k}" for k in self.keys])).distinct()
        return held.groupBy(*self.keys).agg(F.count("*").alias("_n")).where(F.col("_n") == len(chosen)).drop("_n")

    def search(self, rows: DataFrame, text: Column, terms: list[str]) -> DataFrame:
        """The rows whose text holds all terms, in any case: those of the candidates, verified."""
        near = self.candidates(terms)
        rows = rows if near is None else rows.join(near, [*self.keys], "left_semi")
        return rows.where(reduce(Column.__and__, [F.lower(text).contains(t.lower()) for t in terms], F.lit(True)))

"""Ranked lexical search: all documents against a stated set of items, as a blocked sparse matrix product.

The left matrix holds how often each item has each term, the right one the integer impact of each term on each document. Items go by
blocks of at most BLOCK_TERMS entries, so what is sent to the tasks is bounded; the table is read once for each block (once in all for
sets of some thousand items). For a block, one pass over the texts writes each document's length and its counts of the block's terms,
a row of the right matrix before weighting; counts over that table give the weights. A second pass takes its rows in blocks, turns
them over to lists by term, and merges for each item the lists of its terms into one row of scores (Gustavson's row-wise product),
of which it keeps the best k of the task. Those are reduced by groups of tasks, then by item, so no task sees more than
k rows of GROUPS groups an item.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z is lower-cased. They are looked up by 64-bit hashes
and then compared byte by byte, so the result is exact. Scores are 64-bit integers; they are exact while
an item has fewer than 3e8 terms.

Each row of items is a query of its own, repeated ids included. A null text has no terms; items without terms and items that
no document shares a term with have no rows. Repeated document rows are documents of their own; among equal scores null ids come last.
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .words import column_bytes, slices, spans, word_hashes

#: Entries of the item matrix in one block of items, and of the document matrix in one block of documents (or those of one document).
BLOCK_TERMS, BLOCK_POSTINGS = 1_000_000, 2_000_000
#: Groups of tasks whose best rows are reduced before the last step.
GROUPS = 64
_POSTINGS = "doc_id long, n long, terms array<int>, tfs array<long>"
_BEST = "item long, item_id long, doc_id long, score long, task_group int"
_LAST = np.iinfo(np.int64).max

_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end of each term, first term of each text and the total)"""
    data = _LOWER[data]
    return data, *spans(data, offsets, _IN_TERM[data])


class Block:
    """A block of items: the ids, the terms' bytes in order of their hashes, and each item's (term, times)."""

    def __init__(self, items: list[tuple[int, int | None, Counter[bytes]]]):
        words = sorted({w for _, _, c in items for w in c})
        data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words], dtype=np.int64)
        hashes = word_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms have one hash; take smaller blocks")
        self.words = [words[i] for i in order]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.data, self.at = np.frombuffer(b"".join(self.words), np.uint8), np.concatenate([[0], np.cumsum(self.size)])
        number = {w: i for i, w in enumerate(self.words)}
        self.items = [(i, item_id, np.array([number[w] for w in c], np.int64), np.array(list(c.values()), np.int64)) for i, item_id, c in items]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among the given terms, their numbers) of those that the block has."""
        hashes = word_hashes(data, start, end)
        number = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[number] == hashes) & (self.size[number] == end - start))
        number = number[hit]
        right, todo, i = np.ones(len(hit), bool), np.arange(len(hit)), 0
        while len(todo := todo[self.size[number[todo]] > i]):
            right[todo] &= data[start[hit[todo]] + i] == self.data[self.at[number[todo]] + i]
            i += 1
        return hit[right], number[right]


def _postings(block: Broadcast):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        for whole in batches:
            for batch in slices(whole, "text"):
                data, start, end, first = _terms(*column_bytes(batch.column("text")))
                hit, number = b.find(data, start, end)
                doc = np.searchsorted(first, hit, "right") - 1
                entries, tf = np.unique(doc * len(b.words) + number, return_counts=True)
                offsets = np.searchsorted(entries, np.arange(batch.num_rows + 1) * len(b.words))
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, t)) for x, t in ((entries % len(b.words), pa.int32()), (tf, pa.int64()))]
                yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), *lists], names=[x.split()[0] for x in _POSTINGS.split(", ")])

    return count


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Each document's m = 100 - 25 + (25 * n * N) div L, exact whatever the size."""
    if len(n) and 25 * int(n.max()) * n_docs > _LAST:
        return np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 75 + 25 * n * n_docs // n_terms


def _best(block: Broadcast, weights: Broadcast, n_docs: int, n_terms: int, k: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        w: np.ndarray = weights.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # per item: scores and ids, best first

        def keep(at: int, score: np.ndarray, ids: np.ndarray) -> None:
            if len(score) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                score, ids = score[score >= least], ids[score >= least]
            if at in best:
                score, ids = np.concatenate([best[at][0], score]), np.concatenate([best[at][1], ids])
            order = np.lexsort((ids, -score))[:k]
            best[at] = score[order], ids[order]

        def product(ids: np.ndarray, n: np.ndarray, lists: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
            doc = np.repeat(np.arange(len(ids)), lists)
            m = lengths(n, n_docs, n_terms)
            impact = w[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            order = np.argsort(terms, kind="stable")
            doc, impact = doc[order], impact[order]
            row = np.searchsorted(terms[order], np.arange(len(w) + 1))
            scores = np.zeros(len(ids), np.int64)
            for at, (_, _, of_item, times) in enumerate(b.items):
                scores[:] = 0
                for t, x in zip(of_item.tolist(), times.tolist(), strict=True):
                    places = slice(row[t], row[t + 1])
                    scores[doc[places]] += x * impact[places]
                some = np.flatnonzero(scores > 0)
                if len(some):
                    keep(at, scores[some], ids[some])

        for batch in batches:
            lists = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            ids, n = batch.column("doc_id").fill_null(_LAST).to_numpy(), batch.column("n").to_numpy()
            terms, tf = batch.column("terms").flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
            ends = np.cumsum(lists)
            a = 0
            while a < len(ids):
                before = int(ends[a - 1]) if a else 0
                z = max(a + 1, int(np.searchsorted(ends, before + BLOCK_POSTINGS, "right")))
                part = slice(before, int(ends[z - 1]))
                product(ids[a:z], n[a:z], lists[a:z], terms[part], tf[part])
                a = z
        group = TaskContext.get().partitionId() % GROUPS
        rows = [(b.items[at][0], b.items[at][1], None if i == _LAST else i, s, group) for at, (score, ids) in sorted(best.items()) for s, i in zip(score.tolist(), ids.tolist(), strict=True)]
        if rows:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.int32()), strict=True)], names=[x.split()[0] for x in _BEST.split(", ")])

    return merge


def _blocks(items: DataFrame) -> Iterator[Block]:
    """Items in blocks of BLOCK_TERMS entries, read one partition at a time."""
    block, size = [], 0
    for i, (item_id, text) in enumerate(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()):
        data, start, end, _ = _terms(*column_bytes(pa.array([text], pa.string())))
        found = Counter(data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True))
        if not found:
            continue
        if block and size + len(found) > BLOCK_TERMS:
            yield Block(block)
            block, size = [], 0
        block.append((i, item_id, found))
        size += len(found)
    if block:
        yield Block(block)


def _search(docs: DataFrame, block: Block, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(block)
    table = materialize(docs.mapInArrow(_postings(sent), _POSTINGS).where("n > 0"), "lexical_search")
    n_docs, n_terms = table.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    weights = np.zeros(len(block.words), np.int64)
    for term, df in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect():  # one row a term of the block
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    best = table.where(F.size("terms") > 0).mapInArrow(_best(sent, spark.sparkContext.broadcast(weights), n_docs, n_terms, k), _BEST)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    few = best.withColumn("r", F.row_number().over(Window.partitionBy("item", "task_group").orderBy(*order))).where(F.col("r") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest scores above 0, equal ones by id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [x for block in _blocks(items) if (x := _search(rows, block, k)) is not None]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")

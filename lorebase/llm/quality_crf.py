"""Document quality from a linear-chain conditional random field over lines.

Each line of a text is labelled good or bad. Its features describe the line and its two neighbours; the chain's transition
weights tie labels of lines in a row. The label's marginal probability of each line comes from forward and backward messages
over the whole text, and the mean of the marginals, weighted by the lines' lengths, is the document's evidence, which a logistic map
turns into a score. Features come from the text's bytes alone: no label, language, source or id enters.

The model is fitted on the driver from the whole texts of at most SAMPLE labelled documents, those with the least hash of their id in
each class, the classes in turn until one has no more; all lines of a training document carry its label. Everything else covers all documents, in one pass without a shuffle.

Null and empty texts have one empty line and get the score of that. Rows whose label is null, or whose document is missing, aren't learned from and take no place in the sample. Where there is no labelled row of
each class, all scores are 0.5. Null ids are scored as any; they count as held out (no remainder of theirs is known).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import column_bytes, slices, spans, word_hashes

#: Bound of what the model is fitted on, in documents.
SAMPLE = 3000
_SYMBOLS, _MARKS = b"#*$%&|<>", b".,;:!?"


@dataclass
class Model:
    """Weights of the features of a line and its neighbours (log-odds of good), transitions [from][to], and the logistic map."""

    weights: np.ndarray
    transitions: np.ndarray
    slope: float
    offset: float


def _table(chosen: bytes | range) -> np.ndarray:
    t = np.zeros(256, np.uint64)
    t[list(chosen)] = 1
    return t


_CLASSES = [_table(c) for c in (range(65, 91), range(97, 123), range(48, 58), _SYMBOLS, _MARKS, b"!", range(128, 192), range(192, 256))]


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x features, length of each line in bytes, first line of each text and the total)."""
    data, offsets = column_bytes(column)
    n_texts = len(offsets) - 1
    newline = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], newline + 1]), kind="stable")
    first = np.concatenate([np.searchsorted(newline, offsets[:-1]) + np.arange(n_texts), [len(begin)]])
    owner = np.repeat(np.arange(n_texts), np.diff(first))
    end = np.empty(len(begin), np.int64)
    end[:-1] = begin[1:] - 1
    last = first[1:] - 1
    end[last] = offsets[1:]
    counts = []
    for a, b in zip(_CLASSES[::2], _CLASSES[1::2], strict=True):  # two counts in one running sum
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((a + (b << np.uint64(32)))[data], out=running[1:])
        both = running[end] - running[begin]
        counts += [both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)]
    upper, lower, digit, symbol, mark, shout, more, wide = (c.astype(np.float64) for c in counts)
    length = (end - begin).astype(np.float64)
    start, stop, _ = spans(data, offsets)
    line = np.searchsorted(begin, start, "right") - 1
    per = lambda w=None: np.bincount(line, w, len(begin))
    words = per()
    size = stop - start
    hashes = word_hashes(data, start, stop)
    same = np.zeros(len(start), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    mixed = np.bincount(line, (hashes >> np.uint64(12)).astype(np.float64), len(begin)) + 3.0 * length
    order = np.lexsort((mixed, owner))
    twin = np.zeros(len(begin), bool)
    equal = (mixed[order][1:] == mixed[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twin[order[1:][equal]] = True
    twin[order[:-1][equal]] = True
    n, w = np.maximum(length, 1), np.maximum(words, 1)
    letters = np.maximum(upper + lower + wide, 1)
    x = np.stack([
        upper / letters, digit / n, np.minimum(1, 4 * symbol / n), mark / n * 5, np.minimum(1, shout / w), (more + wide) / n,
        per(size <= 3) / w, np.minimum(3, per(size) / w / 5), per(size > 20) / w, per(same) / w, twin * 1.0, np.minimum(2, np.log1p(words) / 4), (words == 0) * 1.0,
    ], 1)
    near = np.zeros((len(begin), 3 * x.shape[1] + 3))
    k = x.shape[1]
    near[:, :k] = x
    has_before, has_after = np.ones(len(begin), bool), np.ones(len(begin), bool)
    has_before[first[:-1]] = False
    has_after[last] = False
    near[1:, k : 2 * k] = x[:-1]
    near[:-1, 2 * k : 3 * k] = x[1:]
    near[~has_before, k : 2 * k] = 0
    near[~has_after, 2 * k : 3 * k] = 0
    near[:, -3], near[:, -2], near[:, -1] = ~has_before, ~has_after, 1
    return near, length, first


def _step(message: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The log-odds that a message brings across a transition; t[i][j] from i to j."""
    return np.logaddexp(message + t[1, 1], t[0, 1]) - np.logaddexp(message + t[1, 0], t[0, 0])


def messages(odds: np.ndarray, first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds (with each line's own) and backward log-odds (without) of chains odds[first[i]:first[i+1]], all chains at once."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    ahead, back = odds.copy(), np.zeros_like(odds)
    alive = np.searchsorted(-counts, -np.arange(1, counts.max(initial=0) + 1), "right")  # chains with more than i lines
    for i in range(1, len(alive)):
        at = begin[: alive[i]] + i
        ahead[at] += _step(ahead[at - 1], t)
    end = begin + counts - 1
    for i in range(1, len(alive)):
        at = end[: alive[i]] - i
        back[at] = _step(back[at + 1] + odds[at + 1], t.T)
    return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def evidence(x: np.ndarray, length: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """The length-weighted mean of each text's good marginals."""
    ahead, back = messages(x @ model.weights, first, model.transitions)
    good = _sigmoid(ahead + back)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    weight = length + 1e-3
    return np.bincount(owner, good * weight, len(first) - 1) / np.maximum(np.bincount(owner, weight, len(first) - 1), 1e-12)


def fit(texts: list[str], labels: np.ndarray, steps: int = 120, rate: float = 0.15, penalty: float = 3e-3) -> Model:
    """Maximum likelihood of all lines' labels given the texts, by gradient steps with momentum; then the logistic map of the evidence."""
    parts = [line_features(pa.array([x or "" for x in texts[a : a + 500]])) for a in range(0, len(texts), 500)]
    x, length = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    counts = np.concatenate([np.diff(p[2]) for p in parts])
    first = np.concatenate([[0], np.cumsum(counts)])
    y = np.repeat(labels, counts).astype(np.float64)
    # both classes weigh the same, and long texts no more than short ones
    share = np.repeat(1 / np.where(labels == 1, (labels == 1).sum(), (labels == 0).sum()) / counts, counts) / 2
    inner = np.ones(len(x), bool)
    inner[first[1:] - 1] = False
    a = np.flatnonzero(inner)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        odds = x @ w
        ahead, back = messages(odds, first, t)
        grad = np.empty_like(theta)
        grad[:-4] = x.T @ (share * (y - _sigmoid(ahead + back)))
        after = back[a + 1] + odds[a + 1]
        joint = np.stack([np.full(len(a), t[0, 0]), t[0, 1] + after, ahead[a] + t[1, 0], ahead[a] + t[1, 1] + after], 1)
        joint = np.exp(joint - joint.max(1, keepdims=True))
        joint /= joint.sum(1, keepdims=True)
        seen = np.zeros((len(a), 4))
        seen[np.arange(len(a)), (3 * y[a]).astype(int)] = 1
        grad[-4:] = share[a] @ (seen - joint)
        grad -= penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    e = evidence(x, length, first, model)
    z = np.log((e + 1e-4) / (1 - e + 1e-4))
    p = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps, lightly held back
        q = _sigmoid(p[0] * z + p[1])
        design = np.stack([z, np.ones_like(z)], 1)
        h = (design * (q * (1 - q))[:, None]).T @ design + np.eye(2) * 1e-1
        p = p + np.linalg.solve(h, design.T @ (labels - q) - 1e-1 * (p - np.array([1.0, 0.0])))
    model.slope, model.offset = float(p[0]), float(p[1])
    return model


def _sampled(rows: DataFrame, label_col: str, *order: str) -> DataFrame:
    """At most SAMPLE rows labelled 0 or 1: those least by order in each class, the classes in turn until one has no more."""
    of = [rows.where(F.col(label_col) == c).orderBy(*order).limit(SAMPLE) for c in (0, 1)]
    ranked = of[0].union(of[1]).withColumn("_rank", F.row_number().over(Window.partitionBy(label_col).orderBy(*order)))
    return ranked.orderBy("_rank", label_col).limit(SAMPLE).drop("_rank")


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label", order: Column | None = None) -> Model | None:
    """A model from at most SAMPLE rows of labelled (those least by order in each class), or None where a class is missing."""
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"), (order if order is not None else F.xxhash64(text_col)).alias("o"))
    found = _sampled(rows, "label", "o").collect()
    labels = np.array([r["label"] for r in found], np.int64)
    if len(np.unique(labels)) < 2:
        return None
    return fit([r["text"] for r in found], labels)


def _scorer(model: Model | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                if model is None:
                    s = np.full(batch.num_rows, 0.5)
                else:
                    e = evidence(*line_features(batch.column("text")), model)
                    s = _sigmoid(model.slope * np.log((e + 1e-4) / (1 - e + 1e-4)) + model.offset)
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document. Labels are learned only from rows that aren't held out: crc32(id as text) mod 3 is not 1."""
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(True))
    named = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))  # other columns of docs may have any name
    known = labels.where(~held(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"))
    known = known.where(F.col("label").isin(0, 1)).join(named.select(F.col("_doc").alias("_id")), "_id", "left_semi").withColumn("_o", F.xxhash64("_id"))
    known = F.broadcast(_sampled(known, "label", "_o", "_id"))
    model = train(named.join(known, F.col("_doc") == F.col("_id")).select("_text", "label", "_id"), "_text", "label", F.xxhash64("_id"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int")

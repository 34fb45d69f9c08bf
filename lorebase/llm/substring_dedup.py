"""Removal of passages that stand elsewhere in the corpus, by suffix automata of reference shards.

A window is `width` words in a row. Words under a window whose words also start anywhere else (in the same text too) go;
windows are judged on the input.

1. Each window has an anchor, the least hash of its `anchor` word runs, so equal windows have equal anchors, and windows in a row mostly share
   one. Anchors that come once in the corpus rule out their windows; texts without others are done at once.
2. Hashes of the windows left are counted; of those that come again, the text with the least row hash is the reference. Its
   windows join up to passages: one copy of all that is repeated.
3. Passages are dealt to shards by anchor; a shard of more than SHARD_WORDS words is split. Suffix automata of shards meet blocks of at
   most BLOCK document runs with anchors of that shard. A matching statistic of at least `width` words marks its window.
   A passage that a third of all documents hold is one passage in one small shard; that shard is copied to each TOGETHER blocks of the runs
   that meet it, and a task gets no more of them under one key.

Hashes have 64 bits. Null and empty texts have no words. Rows with equal id and text are documents of their own (each is repeated by the
other), and get equal results; null ids are ids like any other. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, few, materialize
from .words import column_bytes, slices, spans, window_hashes, word_hashes

SHARD_WORDS, BLOCK, TOGETHER = 200_000, 2000, 4


class SuffixAutomaton:
    """Of word sequences: every run of words within one of them leads from the root to a state."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state that word leads to from p, of length one more than p's: a copy is split off where it is longer."""
        nxt, link, length = self.next, self.link, self.length
        q = nxt[p][word]
        if length[q] == length[p] + 1:
            return q
        copy = self._state(length[p] + 1, link[q], nxt[q].copy())
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def add(self, words: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            if word in nxt[last]:
                last = self._split(last, word)
                continue
            state, p = self._state(length[last] + 1, 0, {}), last
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = state
                p = link[p]
            if p >= 0:
                link[state] = self._split(p, word)
            last = state

    def matches(self, words: list[bytes], width: int) -> list[int]:
        """The first word of each run of width words that stands in a sequence."""
        nxt, link, length = self.next, self.link, self.length
        state, n, found = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                n = length[state]
            to = nxt[state].get(word)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
                if n >= width:
                    found.append(i - width + 1)
        return found


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    size = 1
    while size * 2 <= n:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values if size == n else np.minimum(values[: len(values) - (n - size)], values[n - size :])


class _Windows:
    """The windows of a column of texts: hash and anchor of each that lies in one text, its text and first word."""

    def __init__(self, column: pa.Array, width: int, anchor: int):
        self.data, offsets = column_bytes(column)
        self.start, self.end, self.first = spans(self.data, offsets)
        hashes = word_hashes(self.data, self.start, self.end)
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        n = len(hashes) - width + 1
        if n <= 0:
            self.at = self.owner = np.zeros(0, np.int64)
            self.hash = self.anchor = np.zeros(0, np.int64)
            return
        self.at = np.flatnonzero(owner[:n] == owner[width - 1 :])
        self.owner = owner[self.at]
        self.hash = window_hashes(hashes, width)[self.at].view(np.int64)
        grams = window_hashes(hashes, anchor)
        self.anchor = _least(grams, width - anchor + 1)[self.at].view(np.int64)
        self.leads = grams[self.at].view(np.int64) == self.anchor  # the window begins with its anchor

    def places(self) -> np.ndarray:
        """The first window of each run that has its anchor at one and the same place: no two windows of such a run are equal."""
        if not len(self.at):
            return self.at
        return np.flatnonzero(np.r_[True, self.leads[:-1] | (self.at[1:] != self.at[:-1] + 1) | (self.anchor[1:] != self.anchor[:-1]) | (self.owner[1:] != self.owner[:-1])])

    def runs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) index of each run of chosen windows in a row with one anchor in one text."""
        i = np.flatnonzero(chosen)
        if not len(i):
            return i, i
        new = np.r_[True, (self.at[i][1:] != self.at[i][:-1] + 1) | (self.anchor[i][1:] != self.anchor[i][:-1]) | (self.owner[i][1:] != self.owner[i][:-1])]
        begin = np.flatnonzero(new)
        return i[begin], i[np.r_[begin[1:], len(i)] - 1]

    def text(self, first: int, last: int, width: int) -> bytes:
        """The words from window first to the end of window last."""
        return self.data[self.start[self.at[first]] : self.end[self.at[last] + width - 1]].tobytes()

    def under(self, lists: list[bytes | None]) -> np.ndarray:
        """Which windows have an anchor in their text's list of 64-bit anchors."""
        return self.listed(self.anchor, lists)

    def listed(self, values: np.ndarray, lists: list[bytes | None]) -> np.ndarray:
        out = np.zeros(len(values), bool)
        cuts = np.searchsorted(self.owner, np.arange(len(lists) + 1))
        for i, x in enumerate(lists):
            if x and cuts[i] < cuts[i + 1]:
                out[cuts[i] : cuts[i + 1]] = np.isin(values[cuts[i] : cuts[i + 1]], np.frombuffer(x, np.int64))
        return out


def _anchors(width: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = _Windows(batch.column("text"), width, anchor)
                first = w.places()
                owner, anchors = w.owner[first], w.anchor[first]
                order = np.lexsort((anchors, owner))
                owner, anchors = owner[order], anchors[order]
                new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (anchors[1:] != anchors[:-1])]) if len(owner) else owner
                rid = np.asarray(batch.column("rid"))
                yield pa.record_batch([pa.array(anchors[new]), pa.array(rid[owner[new]]), pa.array(np.diff(np.r_[new, len(owner)]).astype(np.int32))], names=["anchor", "rid", "n"])

    return run


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without repeated anchors are done; the others go on with their anchors packed."""
    for whole in batches:
        for batch in slices(whole, "text"):
            lists = batch.column("anchors").to_pylist()
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            words = [None if a else x.split() for a, x in zip(lists, texts, strict=True)]
            yield pa.record_batch([
                batch.column("rid"), batch.column("doc_id"), pa.array([x.decode() if a else None for a, x in zip(lists, texts, strict=True)], pa.string()),
                pa.array([np.asarray(a, np.int64).tobytes() if a else None for a in lists], pa.binary()),
                pa.array([None if w is None else len(w) for w in words], pa.int64()), pa.array([None if w is None else _digest(w) for w in words], pa.string()),
            ], names=["rid", "doc_id", "text", "anchors", "n_words", "kept_sha256"])


def _window_rows(width: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = _Windows(batch.column("text"), width, anchor)
                i = np.flatnonzero(w.under(batch.column("anchors").to_pylist()))
                yield pa.record_batch([pa.array(w.hash[i]), pa.array(np.asarray(batch.column("rid"))[w.owner[i]])], names=["hash", "rid"])

    return run


def _passages(width: int, anchor: int):
    """Reference passages: the first place of each listed window in its text, joined up while they follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = _Windows(batch.column("text"), width, anchor)
                chosen = w.listed(w.hash, [np.asarray(x, np.int64).tobytes() for x in batch.column("hashes").to_pylist()])
                i = np.flatnonzero(chosen)
                order = np.lexsort((i, w.hash[i], w.owner[i]))
                again = np.zeros(len(i), bool)
                h, o = w.hash[i][order], w.owner[i][order]
                again[order[1:]] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
                chosen[i[again]] = False
                first, last = w.runs(chosen)
                yield pa.record_batch([pa.array(w.anchor[first]), pa.array([w.text(a, b, width) for a, b in zip(first, last, strict=True)], pa.binary()), pa.array((w.at[last] - w.at[first] + width).astype(np.int64))], names=["anchor", "passage", "n_words"])

    return run


def _runs(width: int, anchor: int):
    """Document runs: windows in a row under one repeated anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = _Windows(batch.column("text"), width, anchor)
                first, last = w.runs(w.under(batch.column("anchors").to_pylist()))
                rid = np.asarray(batch.column("rid"))[w.owner[first]]
                place = (w.at[first] - w.first[w.owner[first]]).astype(np.int32)
                yield pa.record_batch([pa.array(w.anchor[first]), pa.array(rid), pa.array(place), pa.array([w.text(a, b, width) for a, b in zip(first, last, strict=True)], pa.binary())], names=["anchor", "rid", "start", "text"])

    return run


def _match(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple[int, int], SuffixAutomaton] | None = None
        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                if held is None or held[0] != (r["shard"], r["sub"]):
                    automaton = SuffixAutomaton()
                    for passage in r["passages"]:
                        automaton.add(passage.split())
                    held = (r["shard"], r["sub"]), automaton
                found = [(x["rid"], held[1].matches(x["text"].split(), width), x["start"]) for x in r["members"]]
                found = [(rid, np.asarray(m, np.int32) + start) for rid, m, start in found if m]
                if found:
                    yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["rid", "starts"])

    return run


def _cut(width: int):
    """The texts without the words under marked windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                out: list[tuple] = []
                for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                    words = text.encode().split()
                    change = np.zeros(len(words) + 1, np.int64)
                    if starts:
                        at = np.unique(np.frombuffer(b"".join(starts), np.int32))
                        change[at] += 1
                        change[at + width] -= 1
                    gone = np.cumsum(change)[:-1] > 0
                    kept = [words[i] for i in np.flatnonzero(~gone)]
                    out.append((len(words), int(gone.sum()), _digest(kept), b" ".join(kept).decode()))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _shard(anchor: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(anchor), n).cast("int")


def remove_repeats(df: DataFrame, width: int = 35, anchor: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of each row; kept is the text that is left where words were looked for, null where nothing repeats."""
    docs = df.select(F.xxhash64(id_col, text_col).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    anchors = materialize(docs.select("rid", "text").mapInArrow(_anchors(width, anchor), "anchor long, rid long, n int"), "anchors")
    again = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    listed = anchors.select("anchor", "rid").join(again, "anchor").groupBy("rid").agg(F.collect_set("anchor").alias("anchors"))
    parted = materialize(docs.join(listed, "rid", "left").mapInArrow(_parted, "rid long, doc_id long, text string, anchors binary, n_words long, kept_sha256 string"), "parted")
    drop_table(anchors)
    texts = parted.where("anchors IS NOT NULL")
    same = texts.select("rid", "text", "anchors")
    # the reference: one text for each window that comes again
    counted = same.mapInArrow(_window_rows(width, anchor), "hash long, rid long").groupBy("hash").agg(F.count("*").alias("n"), F.min("rid").alias("rid")).where("n > 1")
    hashes = counted.groupBy("rid").agg(F.collect_list("hash").alias("hashes"))
    one_each = same.select("rid", "text").join(hashes, "rid").dropDuplicates(["rid"])
    passages = materialize(one_each.select("text", "hashes").mapInArrow(_passages(width, anchor), "anchor long, passage binary, n_words long"), "passages")
    total = passages.agg(F.sum("n_words")).first()[0] or 0
    n_shards = F.lit(max(1, -(-4 * total // SHARD_WORDS)))
    of_shard = passages.withColumn("shard", _shard("anchor", n_shards))
    subs = of_shard.groupBy("shard").agg(F.ceil(F.sum("n_words") / SHARD_WORDS).alias("subs"))
    shards = of_shard.join(subs, "shard").withColumn("sub", F.pmod(F.xxhash64("passage"), "subs").cast("int")).groupBy("shard", "sub").agg(F.collect_list("passage").alias("passages"))
    runs = same.mapInArrow(_runs(width, anchor), "anchor long, rid long, start int, text binary").withColumn("shard", _shard("anchor", n_shards))
    runs = materialize(runs.drop("anchor"), "runs")
    blocks_of = runs.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    runs_of = runs.join(few(blocks_of), "shard").withColumn("block", F.pmod(F.xxhash64("rid", "start"), "blocks")).withColumn("heap", F.floor(F.col("block") / TOGETHER))
    # dealt by heap, or else the grouping would stay with the join on the shard, in one task for a hot one
    blocks = runs_of.repartition("shard", "heap").groupBy("shard", "heap", "block").agg(F.collect_list(F.struct("rid", "start", "text")).alias("members"))
    heaps_of = blocks_of.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / TOGETHER))).alias("heap"))
    copies = shards.join(heaps_of, "shard").repartition("shard", "heap")
    met = blocks.join(copies, ["shard", "heap"]).select("shard", "sub", "passages", "members")
    marks = materialize(met.mapInArrow(_match(width), "rid long, starts binary"), "marks")
    drop_table(runs, passages)
    marked = marks.groupBy("rid").agg(F.collect_list("starts").alias("starts"))
    cut = texts.select("rid", "doc_id", "text").join(marked, "rid", "left").select("doc_id", "text", "starts").mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    done = parted.where("anchors IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    return cut.unionByName(done)

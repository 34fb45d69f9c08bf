"""Word-piece token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest vocabulary entry at the start of a word, then the longest continuation
("##") entry, and so on. A trie over the vocabulary with a failure link at each node does so in one pass: where no child
fits, the link leads to the node of what is left after the longest matches, and the number of pieces popped on the way was
counted when the trie was built. So counts come without building a piece.

A word that can't be split counts as one unknown token. Null and empty texts have no words and no tokens. Null ids, repeated
rows and further columns pass through as they are; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD
from .words import slices


class Automaton(dict):
    """self[word]: tokens, negative where the word is unknown. A bounded cache of words in front of the automaton."""

    def __init__(self, vocabulary: list[str], most: int = 300_000):
        self.most = most
        # node 0: the start of a word; node 1: a continuation's start
        self.child: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for entry in vocabulary:
            node = 1 if entry.startswith("##") and len(entry) > 2 else 0
            for c in entry[2:] if node else entry:
                nxt = self.child[node].get(c)
                if nxt is None:
                    nxt = self.child[node][c] = len(self.child)
                    self.child.append({})
                    ends.append(False)
                node = nxt
            ends[node] = True
        n = len(self.child)
        self.fail, self.pops = [-1] * n, [0] * n
        todo = deque((root, c, v) for root in (0, 1) for c, v in self.child[root].items())
        while todo:
            parent, c, v = todo.popleft()
            if ends[v]:
                self.fail[v], self.pops[v] = 1, 1
            else:
                z, popped = self.fail[parent], self.pops[parent]
                while z >= 0 and c not in self.child[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.child[z][c], popped
            todo.extend((v, d, w) for d, w in self.child[v].items())

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self.count(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def count(self, word: str) -> int:
        child, fail, pops, node, total = self.child, self.fail, self.pops, 0, 0
        for c in word:
            while (nxt := child[node].get(c)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = nxt
        while node != 1:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return -1
        return total


@lru_cache(2)
def vocabulary_of(path: str) -> tuple[str, ...]:
    """A word-piece vocabulary from a tokenizers file: a word-piece model's own entries, or a word BPE's, each of which may
    begin a word or continue one. Byte-level names of entries are turned back into text; those that aren't text are left out."""
    model = json.loads(Path(path).read_text())["model"]
    if model.get("type") == "WordPiece":
        return tuple(model["vocab"])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    end, found = model.get("end_of_word_suffix") or "", set()
    for entry in model["vocab"]:
        try:
            text = bytes(names[c] for c in entry.removesuffix(end) if c in names).decode()
        except UnicodeDecodeError:
            continue
        if text and not text.isspace():
            found.add(text)
    return tuple(x for text in sorted(found) for x in (text, f"##{text}"))


@lru_cache(1)
def automaton_of(path: str) -> Automaton:
    """One for each Python worker: its cache serves all tasks that the worker runs."""
    return Automaton(list(vocabulary_of(path)))


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, automaton = re.compile(WORD).findall, automaton_of(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                n_words, n_tokens, n_unknown = [], [], []
                for text in batch.column("text").to_pylist():
                    counts = list(map(automaton.__getitem__, words(text.lower()))) if text else []
                    unknown = counts.count(-1)
                    n_words.append(len(counts))
                    n_unknown.append(unknown)
                    n_tokens.append(sum(counts) + 2 * unknown)
                yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return count


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of each row: greedy word pieces of its lower-cased words. No shuffle."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counter(tokenizer), "doc_id long, n_words long, n_tokens long, n_unknown long")

"""Token ids of whole texts by a tokenizers file, each distinct piece of text encoded once.

Byte-level and word BPE never merge across their pre-tokens, and pre-tokens never reach past white space (a byte-level
one may begin with one space). So a text's ids are those of its white-space-delimited pieces in a row, and since most
pieces come again, a bounded cache of pieces saves most of the work. tests/llm holds this against encoding whole texts.
"""

from __future__ import annotations

import array
import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

#: Fixed value: the characters that the tokenizers' pattern class \s matches.
UNICODE_SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


#: Finds what isn't Latin or punctuation, and U+0130: characters whose lower case or composition isn't one plain letter for another.
_NOT_SIMPLE = re.compile("[^\x00-\u012f\u0131-\u024f\u2000-\u206f]").search


class Encoder:
    """texts(list) gives each text's ids as native unsigned 32-bit integers. Known pieces are kept in two
    generations of at most `most` each: a full one becomes the old one, of which pieces that come again are taken over.

    Pieces not yet known are encoded in one call, with a special token of the vocabulary between each two.
    """

    def __init__(self, path: str, most: int = 700_000):
        spec = json.loads(Path(path).read_text())
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        before, s = spec.get("pre_tokenizer") or {}, UNICODE_SPACES
        self.pieces, self.between = None, None
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.fold = bool(steps) and steps[-1]["type"] == "Lowercase"
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        # a word of Latin letters before closing marks is a pre-token, and so are the marks; not U+0130, which lower case turns into two characters
        mark = f"[.,;:!?]++(?![^{s}])"
        word = f"[A-Za-zÀ-ÖØ-öø-įı-ɏ]++(?={mark})"
        special = [x for x in spec.get("added_tokens", []) if x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"])]
        if special and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer"):
            self.pieces = re.compile(f" ?{word}|{mark}| ?[^{s}]+|[{s}]+(?![^{s}])|[{s}]+").findall
        elif special and before.get("type") == "Sequence" and before["pretokenizers"][0]["type"] == "Split" and before["pretokenizers"][0]["behavior"] == "Removed" and before["pretokenizers"][0]["invert"]:
            self.pieces = re.compile(f"{word}|{mark}|[^{s}]+").findall
        if self.pieces:
            self.between = (special[-1]["content"], special[-1]["id"])

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        mark, mark_id = self.between
        for x in [x for x in pieces if "<" in x]:  # it may hold a special token itself
            self.known[x] = self.whole(x)
        pieces = [x for x in pieces if "<" not in x]
        for a in range(0, len(pieces), 20_000):
            part = pieces[a : a + 20_000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == mark_id)
            begin, end = np.r_[0, cuts + 1] * 4, np.r_[cuts, len(ids)] * 4
            data = ids.tobytes()
            self.known.update((x, data[b:e]) for x, b, e in zip(part, begin.tolist(), end.tolist(), strict=True))

    def texts(self, texts: list[str | None]) -> list[bytes]:
        if self.pieces is None:
            return [self.whole(x or "") for x in texts]
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        given = texts
        if self.fold:  # where lower case is simple it may come first: fewer pieces differ
            texts = [x if not x or _NOT_SIMPLE(x) else x.lower() for x in texts]
        # a text that holds an added token is cut there first, which changes how white space before it is taken: such texts are encoded whole
        odd = {i: self.whole(given[i]) for i, x in enumerate(texts) if x and any(a in x for a in self.added)}
        split = [self.pieces(x or "") if i not in odd else [] for i, x in enumerate(texts)]
        missing = set().union(*split).difference(self.known)
        again = missing.intersection(self.old)
        self.known.update((x, self.old[x]) for x in again)
        self._learn(list(missing.difference(again)))
        get = self.known.__getitem__
        return [odd[i] if i in odd else b"".join(map(get, x)) for i, x in enumerate(split)]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker: its cache serves all tasks that the worker runs."""
    return Encoder(path)

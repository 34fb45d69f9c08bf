"""Line dedup: lists up to CROWD lines meet whole, longer ones by their leads first; the result is that of brute force either way."""

import random
from collections import Counter

import pytest
from lorebase.llm import line_dedup

SCHEMA = "doc_id long, text string"


def _rows():
    r = random.Random(9)
    base = [f"w{i}" for i in range(24)]
    lines = []
    for _ in range(60):  # a group of near copies, some of them too far from others
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(24)] = f"x{r.randint(0, 30)}"
        lines.append(" ".join(w))
    long = [f"v{i}" for i in range(150)]
    lines += [" ".join([*long[:k], f"y{k}", f"y{k}", *long[k + 1 :]]) for k in (3, 50, 149)] + [" ".join(long[:119]), " ".join(long[:120]), "  lone  word ", "word lone", "lone", ""]
    r.shuffle(lines)
    return [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(len(lines) // 4 + 1)]


def _expected(rows):
    earlier, want = [], Counter()
    for i, text in rows:
        n = gone = 0
        for line in text.split("\n"):
            s = frozenset(line.split())
            if s:
                n += 1
                gone += any(5 * len(s & t) >= 4 * len(s | t) for t in earlier)
                earlier.append(s)
        want[i, n, gone] += 1
    return want


@pytest.mark.parametrize(("crowd", "heavy"), [(0, 1 << 14), (8, 1 << 14), (8, 5), (256, 1 << 14)])
def test_lists_of_any_length(spark, monkeypatch, crowd, heavy):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    written = []
    real = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: written.append(name) or real(df, name))
    rows = _rows()
    out = line_dedup.line_dedup_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"]) for r in out) == _expected(rows)
    # no pass of leads where no list is long, so that lists are made and shuffled once
    parts = written.count("part")
    assert parts == line_dedup.PARTS if crowd == 256 else parts > line_dedup.PARTS


def test_pairs_are_verified_on_hashes(spark, monkeypatch):
    written = []
    real = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: written.append((name, df.schema)) or real(df, name))
    line_dedup.line_dedup_report(spark.createDataFrame([(1, "a b c d e\na b c d e f"), (2, "x y")], SCHEMA)).collect()
    assert {schema["w"].dataType.simpleString() for name, schema in written if name == "needed"} == {"array<bigint>"}


def test_a_list_is_no_longer_than_its_place(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", 2)
    lines = spark.createDataFrame([("a b",), ("a c",), ("a d",), ("b e",)], "line string")
    _, heavy, crowded = line_dedup._rarity(lines)
    # three words' places have one word, b's two, a's three: a's alone can have a long list
    assert crowded == (line_dedup._PLACES // 2 - 1) << 16 and heavy == (line_dedup._PLACES // 2) << 16

"""The training-data operators against brute force on small tables, with nulls, empty and repeated rows and clashing column names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from lorebase.llm import common, line_dedup, mixing, near_dedup, packing, quality_crf, quality_rules, substring_dedup, token_counts, token_output, vector_topk
from lorebase.llm.common import materialize
from lorebase.llm.components import components
from lorebase.llm.encoding import Encoder
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(text):
    return WORDS.findall(text or "")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *(r or ("en", "a")), len(t or "")) for i, t, *rest in rows for r in [rest[0] if rest else None]], SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \n\t"), (4, "x"), (4, "x"), (5, "é   日本 <|endoftext|> b\x1cc"), (6, "w " * 9000)]
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


# encoding, token files, packing


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_whole_texts(path):
    r = random.Random(3)
    bits = [" ", "  ", "\n", "\t\n", "a", "The", "the.", "it's", "É", "é", "日本", "12", "3.4", "!?", "...", " ", " ", "<|endoftext|>", "<", "\x1c", "'ll", "_x", "ﬁ", "İ", "́", "\x85"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    e = Encoder(path, most=500)
    for a in range(0, 3000, 300):
        part = texts[a : a + 300]
        assert [x == e.whole(t) for x, t in zip(e.texts(part), part, strict=True)] == [True] * 300


def expected_ids(path, end, text):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


def test_token_files(spark, sample):
    df = frame(spark, ODD).unionByName(sample.select(F.col("doc_id") + 100, *[c for c in sample.columns if c != "doc_id"]).toDF(*sample.columns))
    rows = token_output.token_file_digest(df, WORD, 2).collect()
    docs = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == [d["doc_id"] for d in docs]
    at = 0
    tok = Tokenizer.from_file(WORD)
    for r, d in zip(sorted(rows, key=lambda r: r["start"]), docs, strict=True):
        ids = np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_output.token_file_digest(df.limit(0), WORD, 2).count() == 0


@pytest.mark.parametrize("range_rows", [40, 25_000])
def test_packing(spark, sample, monkeypatch, range_rows):
    monkeypatch.setattr(packing, "RANGE_ROWS", range_rows)
    df = frame(spark, ODD).unionByName(sample.withColumn("doc_id", F.col("doc_id") + 1000))
    rows = packing.pack_documents(df, BYTE, 0, 512).toPandas()
    tok = Tokenizer.from_file(BYTE)
    want = Counter()
    for doc_id, text in df.select("doc_id", "text").collect():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 512 + 1
        for piece, start in enumerate([0, *range(first, len(ids), 512)]):
            n = 512 if piece else first
            want[doc_id, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    assert Counter((None if d != d else d, p, s, n, c) for d, p, s, n, c in zip(rows.doc_id, rows.piece, rows.start, rows.length, rows.ids_crc32, strict=True)) == want
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for (t,) in df.select("text").collect())
    assert rows.length.sum() == total
    by = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.sum() <= 512).all()
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    assert rows.sequence_id.nunique() <= -(-total // 512) * 1.03 + 2
    assert packing.pack_documents(df.limit(0), BYTE).count() == 0


def test_word_piece_counts(spark):
    r = random.Random(1)
    entries = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(12)} | {"a", "b"})
    vocabulary = [*entries, *(f"##{x}" for x in entries[::2]), "##a", "[UNK]"]
    tok = Tokenizer(models.WordPiece({v: i for i, v in enumerate(dict.fromkeys(vocabulary))}, unk_token="[UNK]", max_input_chars_per_word=10_000))
    tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    automaton = token_counts.Automaton([v for v in vocabulary if v != "[UNK]"])
    for _ in range(3000):
        word = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randint(1, 14)))
        got = tok.encode(word, add_special_tokens=False).tokens
        assert automaton[word] == (-1 if got == ["[UNK]"] else len(got))
    rows = {(x["doc_id"], x["n_words"]): x for x in token_counts.token_counts(frame(spark, ODD), WORD).collect()}
    assert rows[1, 0]["n_tokens"] == 0 and rows[4, 1]["n_tokens"] == 1 and rows[6, 9000]["n_tokens"] == 9000


def test_word_piece_counts_of_a_table(spark, sample):
    """Against a greedy splitter that tries all prefixes, longest first."""
    entries = set(token_counts.vocabulary_of(WORD))
    longest = max(map(len, entries))
    known = {}

    def pieces(word):
        if word not in known:
            at, n = 0, 0
            while at < len(word):
                size = next((k for k in range(min(longest, len(word) - at), 0, -1) if ("##" if at else "") + word[at : at + k] in entries), 0)
                if not size:
                    n = -1
                    break
                at, n = at + size, n + 1
            known[word] = n
        return known[word]

    want = Counter()
    for doc_id, text in sample.select("doc_id", "text").collect():
        found = [pieces(w) for w in words((text or "").lower())]
        want[doc_id, len(found), sum(1 if n < 0 else n for n in found), sum(n < 0 for n in found)] += 1
    assert Counter(map(tuple, token_counts.token_counts(sample, WORD).collect())) == want


# quality


def base_counts(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = [False] * len(w)
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            covered[i] = covered[i + 1] = covered[i + 2] = True
    n = sum(covered)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)


def test_quality_rules(spark, sample):
    df = frame(spark, [*ODD, (7, "a b a b a b c"), (8, "q r s\nq r s\nt"), (9, "z z z z", (None, None))]).unionByName(sample)
    got = quality_rules.quality_report(df)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = Counter((d["doc_id"], *base_counts(d["text"])) for d in df.collect())
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got.collect()) == want
    verdicts = {r["doc_id"]: r["kept"] for r in quality_rules.quality_report(sample).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1 and not base_counts(sample.where(F.col("doc_id") == d).first()["text"])[-1]]
    assert all(verdicts[d] for d in good)
    clash = sample.withColumn("words", F.lit(1)).withColumn("h", F.lit("x")).withColumn("lang2", F.col("lang"))
    kept = quality_rules.filter_documents(clash)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == {d for d, k in verdicts.items() if k}
    assert quality_rules.quality_report(df.limit(0)).count() == 0


def test_jensen_shannon(spark):
    rows = spark.createDataFrame([([1, 0], [0, 1]), ([2, 2], [1, 1]), ([0, 0], [1, 1])], "a array<long>, b array<long>").select(quality_rules.jensen_shannon(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in rows] == [pytest.approx(1.0), pytest.approx(0.0), None]


def test_crf_messages_are_exact():
    r = np.random.default_rng(0)
    t, first = r.normal(size=(2, 2)), np.array([0, 5, 6, 10])
    odds = r.normal(size=10)
    ahead, back = quality_crf.messages(odds, first, t)
    for a, b in itertools.pairwise(first):
        total, good = 0.0, np.zeros(b - a)
        for labels in itertools.product((0, 1), repeat=int(b - a)):
            p = np.exp(sum(odds[a + i] * y for i, y in enumerate(labels)) + sum(t[x, y] for x, y in itertools.pairwise(labels)))
            total += p
            good += p * np.array(labels)
        assert 1 / (1 + np.exp(-(ahead + back)[a:b])) == pytest.approx(good / total)


def test_quality_scores(spark, sample):
    df = frame(spark, [(None, None), (10_001, ""), (10_002, "a\n\nb")]).unionByName(sample)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_crf.quality_scores(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert {r["score"] for r in quality_crf.quality_scores(df, labels.where("quality = 1")).collect()} == {0.5}


# duplicates


def test_substring_dedup(spark, sample):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, passage + " end"), (1, None), (2, ""), (3, "start " + passage), (4, "tick " * 80), (5, "once " + " ".join(f"u{i}" for i in range(90))), (6, "same row " * 3), (6, "same row " * 3), (7, " ".join(f"p{i}" for i in range(34)))]
    df = frame(spark, rows).unionByName(sample)
    docs = [(d["doc_id"], words(d["text"])) for d in df.collect()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in docs for i in range(len(w) - 34))
    want = Counter()
    for doc_id, w in docs:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df).collect())
    assert got == want and sum(n for (_, _, n, _) in want) > 100
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_hot_passage_is_spread(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 20)
    passage = " ".join(f"p{i}" for i in range(60))
    df = frame(spark, [(i, f"{passage} own{i}") for i in range(600)] + [(1000 + i, f"alone{i} " * 5) for i in range(1200)])
    rows = substring_dedup.remove_repeats(df).collect()
    assert sum(r["n_removed"] for r in rows) == 600 * 60
    runs = []

    def counted(width):
        def run(batches):
            n = 0
            for b in batches:
                n += sum(len(x) for x in b.column("members").to_pylist())
            yield pa.record_batch([pa.array([n]), pa.array([b""], pa.binary())], names=["rid", "starts"])

        return run

    monkeypatch.setattr(substring_dedup, "_match", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        monkeypatch.setattr(substring_dedup, "materialize", lambda df, name: (runs.extend(r["rid"] for r in df.collect()) if name == "marks" else None, materialize(df, name))[1])
        substring_dedup.remove_repeats(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(runs) >= 600 and max(runs) <= sum(runs) / 2


def test_suffix_automaton():
    r = random.Random(1)
    for _ in range(200):
        texts = [[r.choice("ab").encode() for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 5))]
        a = substring_dedup.SuffixAutomaton()
        for t in texts:
            a.add(t)
        q = [r.choice("abc").encode() for _ in range(20)]
        for n in (1, 2, 4):
            runs = {tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1)}
            assert a.matches(q, n) == [i for i in range(len(q) - n + 1) if tuple(q[i : i + n]) in runs]


@pytest.mark.parametrize(("few", "heavy"), [(0, 1 << 14), (1_000_000, 3)])
def test_line_dedup(spark, sample, monkeypatch, few, heavy):
    monkeypatch.setattr(common, "FEW", few)
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    base = [f"w{i}" for i in range(20)]
    near = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(20)]
    rows = [(i, f"{line}\n\n{line}") for i, line in enumerate(near, 500)] + [(520, None), (521, ""), (522, "\n \n"), (523, "c b a"), (524, "a b c\nd"), (525, "twice told\n\ntale"), (525, "twice told\n\ntale"), (None, "a b c"), (None, "a b c")]
    df = frame(spark, rows).unionByName(sample)
    docs = sorted(df.collect(), key=lambda d: (d["doc_id"] is None, d["doc_id"] or 0))
    earlier, want = [], Counter()
    for d in docs:
        keep, n, gone = [], 0, 0
        for line in (d["text"] or "").split("\n"):
            s = frozenset(words(line))
            if not s:
                keep.append(line)
                continue
            n += 1
            if any(5 * len(s & t) >= 4 * len(s | t) for t in earlier if 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t))):
                gone += 1
            else:
                keep.append(line)
            earlier.append(s)
        want[d["doc_id"], n, gone, hashlib.sha256("\n".join(keep).encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in line_dedup.line_dedup_report(df).collect())
    assert got == want
    clash = sample.withColumn("lid", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("gone", F.lit(3))
    assert line_dedup.dedup_lines(clash).columns[:-2] == clash.columns
    assert line_dedup.line_dedup_report(df.limit(0)).count() == 0


def jaccard_classes(docs):
    sets = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None for w in (words(t) for _, t in docs)]
    label = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and 5 * (a & b).total() >= 4 * (a | b).total():
            x, y = label[i], label[j]
            label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@pytest.mark.parametrize(("block", "block_shingles", "few"), [(3, 1 << 20, 0), (256, 1 << 20, 0), (256, 300, 1_000_000)])
def test_near_duplicates(spark, monkeypatch, block, block_shingles, few):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block_shingles)
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(common, "FEW", few)
    r = random.Random(5)
    rows, n = [], 0
    for group in range(6):
        base = [f"g{group}w{r.randint(0, 400)}" for _ in range(120)]
        for _ in range(9):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(120)] = f"e{r.randint(0, 10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    song = "these are the words of a song that comes again and again "
    rows += [(910 + i, song * 20 + f"end {i}") for i in range(3)] + [(920, song * 12 + "end 0")]  # 920 has the same shingles, fewer times
    rows += [(900, "one two"), (901, "one  two"), (902, None), (903, ""), (904, ""), (905, rows[0][1]), (None, "alone")]
    df = frame(spark, rows)
    got = {(r["doc_id"]): r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    label = jaccard_classes(rows)
    first = {}
    for (i, _), v in zip(rows, label, strict=True):
        if i is not None:
            first[v] = min(first.get(v, i), i)
    assert got == {i: (i if i in (902, 903, 904) else first.get(v)) for (i, _), v in zip(rows, label, strict=True)}
    kept = near_dedup.keep_one(df.withColumn("tid", F.lit(0)))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({v for k, v in got.items() if v is not None and k is not None})
    assert kept.columns == [*df.columns, "tid"]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_dart_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], r.integers(0, 2**63, 100).astype(np.uint64)])
    s = near_dedup.dart_signatures(np.concatenate([a, b, a, a]), np.repeat([0, 1, 2, 2], 400), 3, 2048)
    assert (s[0] == s[1]).mean() == pytest.approx(300 / 500, abs=0.05) and (s[0] == s[2]).all() and (s != 0).all()
    w = near_dedup.dart_signatures(np.concatenate([a[:50], a[:50]]), np.repeat([0, 1], 50), 2, 2048, np.concatenate([np.full(50, 2.5), np.full(50, 1.25)]))
    assert (w[0] == w[1]).mean() == pytest.approx(0.5, abs=0.05)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (6, 7), (7, 8), (9, 9)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in (1, 2, 3)}) == 1 and len({got[i] for i in (4, 5, 6, 7, 8)}) == 1 and len({got[100 + i] for i in range(41)}) == 1
    assert len(set(got.values())) == 3


# mixing and search


def test_mixing(spark, sample):
    df = frame(spark, [(None, "a b", ("en", None)), (1, None, ("en", "tiny")), (2, "one two three", ("en", "tiny")), (3, "x " * 50, ("en", None))]).unionByName(sample)
    rows = mixing.mix_report(df).collect()
    sizes = Counter()
    for d in df.collect():
        sizes[d["source"]] += len(words(d["text"]))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left, w = total - sum(3 * sizes[s] for s in stopped), sum(weight[s] for s in names if s not in stopped)
        over = {s for s in names if s not in stopped and left * weight[s] / w > 3 * sizes[s]}
        if not over:
            break
        stopped |= over
    target = {s: 3 * sizes[s] if s in stopped else left * weight[s] / w for s in names}
    assert stopped and Counter((round(r["target"], 6), r["source_size"]) for r in rows) == Counter((round(target[d["source"]], 6), sizes[d["source"]]) for d in df.collect())
    by = Counter()
    for r in rows:
        by[r["target"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(by[r["target"]] - r["target"] * sum(target[s] == r["target"] for s in names)) <= sum(target[s] == r["target"] for s in names) for r in rows)
    assert sorted(map(tuple, mixing.mix_report(df.repartition(3)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    clash = df.withColumn("size", F.lit(-1)).withColumn("key", F.lit("k"))
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in rows)
    assert mixing.mix_report(df.limit(0)).count() == 0


def test_exact_top_k(spark):
    r = np.random.default_rng(1)
    vectors = [list(map(float, v)) for v in r.normal(size=(300, 6)).astype(np.float32)] + [[0.5] * 6] * 60
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1050, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = vector_topk.exact_top_k(df, F.col("vec_id") % 50 == 0, rows_per_block=64).collect()
    q = {i: np.floor(256 * np.float64(np.float32(v))).astype(int) for i, v in rows[:360]}
    want = set()
    for i in range(0, 360, 50):
        scored = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:5]
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    assert {tuple(x) for x in got} == want
    assert vector_topk.exact_top_k(df.limit(0), F.lit(True)).count() == 0


def test_exact_top_k_of_any_finite_size(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=3) * 10.0 ** r.integers(-3, 6)]) for i in range(60)]
    rows += [(100, [2e7, 1.0]), (101, [1e30, 1.0]), (102, [-1e30, 1.0]), (103, [1e30, -1e30]), (104, [1e300, 1e300]), (105, [1e306, -3.0]), (106, [0.5, -0.25]), (107, [1e30, 1.0])]
    rows += [(200, [1e16, 1.0, -1e16]), (201, [1e16, 3.0, 1e16]), (50, [0.0, 0.0, 0.0]), (50, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = Counter(map(tuple, vector_topk.exact_top_k(df, F.col("vec_id") % 2 == 0, rows_per_block=8, cells=4).collect()))
    whole = [[(256 * int(x)) if abs(x) > 2**53 else int(np.floor(256 * x)) for x in v] for _, v in rows]
    want = Counter()
    for i, (q, v) in enumerate(rows):
        if q % 2 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[i], whole[j], strict=True)), w) for j, (w, u) in enumerate(rows) if j != i and len(u) == len(v))
            want.update((q, n + 1, w, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, w) in enumerate(scored[:5]))
    assert got == want


def test_bytes_and_words():
    from lorebase.llm import words as w

    texts = ["ab cd", None, "", "ef", " x\ty ", "é z"]
    data, offsets = w.column_bytes(pa.array(["skip", *texts]).slice(1))
    start, end, first = w.spans(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end, strict=True)] == [x for t in texts for x in words(t)]
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    h = w.word_hashes(data, start, end)
    assert len(set(h.tolist())) == len(h) and h[0] == w.word_hashes(*[np.frombuffer(b"..ab", np.uint8), np.array([2]), np.array([4])])[0]


def test_classifier_with_clashing_columns(spark, sample):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = ["label", "_id", "_o", "_doc", "_text", "_rank", "quality", "held_out", "score", "predicted", "o"]
    more = sample.withColumns({c: F.lit("x") for c in names})
    plain = {tuple(r) for r in quality_crf.quality_scores(sample, labels).collect()}
    assert {tuple(r) for r in quality_crf.quality_scores(more, labels.withColumns({c: F.lit("x") for c in names if c != "quality"})).collect()} == plain

"""Near-duplicate documents by DartMinHash signatures and a banded join, verified exactly.

Each distinct shingle of five words is an element; its weight is the number of its places in the text. Hashed darts land in
its region (weight x rank) at a rate of one a unit of area, so what two texts share of a region gets equal darts in both. A dart
belongs to one coordinate of the signature, and the dart of least rank stays for each. Ranks are searched up to a bound that fills a
signature for most texts; the bound doubles for those with empty coordinates. Two signatures agree at a coordinate with the
weighted Jaccard similarity (sum of the lesser weights over that of the greater ones) as probability. 32 bands of 4 coordinates
miss a pair at 0.8 with probability under 1e-7.

Equal texts are one node (by a 64-bit hash of the text). Texts that share a band key are joined to the bucket's least
text, never to one another, and the components of those stars are the groups to look at. A group of up to BLOCK texts (and
BLOCK_SHINGLES shingles in all) is compared whole, exactly, by its weighted sets. In a larger group each text is first compared with one
text, of its buckets' least ones that which most others have too; only texts outside the largest verified class meet all texts of the
group, block by block, each block by itself. So no link between different texts is lost, and a class of thousands isn't expanded
into pairs.

Results have one row a document: doc_id, class_id (the least doc_id of its class; its own where it has no near
duplicate). Texts of one to four words are one shingle. Null texts and texts without words form no class with others; a null doc_id gets class_id
null unless its class has another id. Repeated rows are equal texts. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, drop_table, few, materialize
from .components import components
from .words import column_bytes, mix, slices, spans, window_hashes, word_hashes

BANDS, ROWS = 32, 4
BLOCK, BLOCK_SHINGLES = 256, 4 << 20
_U = np.uint64
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def dart_signatures(elements: np.ndarray, owner: np.ndarray, n: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """n x k dart ids of n weighted sets: elements (64-bit hashes) of owner (0..n-1), each with a positive weight (1 where none is given).

    A repeated element throws the same darts again and changes nothing. Sets without elements get zeros."""
    weights = np.ones(len(elements)) if weights is None else weights
    # regions of unit width along the weight axis; the last one of an element may be narrower
    slabs = np.ceil(weights).astype(np.int64)
    slab = np.arange(slabs.sum()) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    width = np.minimum(1.0, np.repeat(weights, slabs) - slab)
    base, of = mix(np.repeat(elements, slabs) + mix(slab.astype(_U) + _U(1))), np.repeat(owner, slabs)
    total = np.bincount(owner, weights, n)
    high = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-9), 0.0)
    low = np.zeros(n)
    best, ids = np.full(n * k, np.inf), np.zeros(n * k, _U)
    while len(base):
        first = np.floor(low).astype(np.int64)
        cells = (np.ceil(high).astype(np.int64) - first)[of]  # of unit area, along the rank axis
        cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells) + np.repeat(first[of], cells)
        h, text, wide = mix(np.repeat(base, cells) ^ mix(cell.astype(_U) * _U(2) + _U(1))), np.repeat(of, cells), np.repeat(width, cells)
        thrown = np.searchsorted(_POISSON, _unit(h))
        for j in range(int(thrown.max(initial=0))):
            at = np.flatnonzero(thrown > j)
            dart = mix(h[at] + _U(j + 1))
            rank = cell[at] + _unit(mix(dart + _U(1)))
            t = text[at]
            ok = (rank >= low[t]) & (rank < high[t]) & (_unit(mix(dart + _U(2))) < wide[at])
            dart, rank = dart[ok], rank[ok]
            place = t[ok] * k + (mix(dart + _U(3)) % _U(k)).astype(np.int64)
            np.minimum.at(best, place, rank)
            won = rank == best[place]
            ids[place[won]] = dart[won]
        open_ = np.isinf(best).reshape(n, k).any(1) & (total > 0)
        low, high = high, high * 2
        stay = open_[of]
        base, of, width = base[stay], of[stay], width[stay]
    return ids.reshape(n, k)


def shingles(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle, its text, words of each text), in order; a text of fewer words than size is one shingle."""
    data, offsets = column_bytes(column)
    start, end, first = spans(data, offsets)
    hashes, counts = word_hashes(data, start, end), np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    windows = window_hashes(hashes, size)
    inside = owner[: len(windows)] == owner[size - 1 : size - 1 + len(windows)]
    short = np.flatnonzero((counts > 0) & (counts < size))
    extra = np.array([np.bitwise_xor.reduce(mix(hashes[first[i] : first[i + 1]] + np.arange(1, counts[i] + 1, dtype=_U))) for i in short], _U)
    return np.concatenate([windows[inside], extra]), np.concatenate([owner[: len(windows)][inside], short]), counts


def weighted(elements: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, owner, places) of each distinct element of each owner, by owner."""
    order = np.lexsort((elements, owner))
    elements, owner = elements[order], owner[order]
    new = np.flatnonzero(np.r_[True, (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])]) if len(elements) else np.zeros(0, np.int64)
    return elements[new], owner[new], np.diff(np.r_[new, len(elements)])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            elements, owner, counts = shingles(batch.column("text"))
            elements, owner, places = weighted(elements, owner)
            signature = dart_signatures(elements, owner, len(counts), BANDS * ROWS, places.astype(np.float64))
            keys = np.zeros((len(counts), BANDS), _U)
            for r in range(ROWS):
                keys = mix(keys * _U(31) + signature[:, r::ROWS][:, :BANDS])
            keys = mix(keys + np.arange(BANDS, dtype=_U)).astype(np.int64)
            full = counts > 0
            tid = np.asarray(batch.column("tid"))[full]
            yield pa.record_batch([pa.array(keys[full].ravel()), pa.array(np.repeat(tid, BANDS))], names=["band", "tid"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sets as plain ones: the n-th place of a shingle is an element of its own, so plain similarity is the weighted one."""
    for whole in batches:
        for batch in slices(whole, "text"):
            elements, owner, counts = shingles(batch.column("text"))
            elements, owner, places = weighted(elements, owner)
            nth = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
            owner = np.repeat(owner, places)
            elements = mix(np.repeat(elements, places) + mix(nth.astype(_U)))
            cuts = np.searchsorted(owner, np.arange(len(counts) + 1))
            packed = pa.array([elements[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
            yield pa.record_batch([batch.column("tid"), packed, pa.array(np.diff(cuts), pa.int64())], names=["tid", "shingles", "n"])


def _similar(left: list[np.ndarray], right: list[np.ndarray] | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with a Jaccard similarity of at least `least`: between left and right, or within left (i < j)."""
    both = left + (right or [])
    sizes = np.array([len(x) for x in both])
    place, which = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), sizes)
    shared = np.zeros((len(left), len(both) - (len(left) if right is not None else 0)), np.float32)
    order = np.argsort(which, kind="stable")
    which, row = which[order], row[order]
    step = max(1, (8 << 20) // len(both))
    for a in range(0, len(place), step):  # an incidence matrix of a run of shingles at a time
        lo, hi = np.searchsorted(which, [a, a + step])
        m = np.zeros((len(both), min(step, len(place) - a)), np.float32)
        m[row[lo:hi], which[lo:hi] - a] = 1
        shared += m[: len(left)] @ (m if right is None else m[len(left) :]).T
    n_left, n_right = sizes[: len(left), None], (sizes if right is None else sizes[len(left) :])[None, :]
    hit = shared >= least * (n_left + n_right - shared) - 1e-6
    i, j = np.nonzero(np.triu(hit, 1) if right is None else hit)
    return i, j


def _links(least: float):
    """Verified links of packed blocks: ids and shingle sets of one block, or of two to be compared with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                left, right = ([np.frombuffer(x["shingles"], _U) for x in r[c]] if r[c] is not None else None for c in ("x", "y"))
                i, j = _similar(left, right, least)
                a = np.array([x["tid"] for x in r["x"]], np.int64)
                b = a if right is None else np.array([x["tid"] for x in r["y"]], np.int64)
                # a forest of the links says as much about classes as all of them
                root: dict[int, int] = {}

                def find(v: int, root=root) -> int:
                    while root.get(v, v) != v:
                        root[v] = root.get(root[v], root[v])
                        v = root[v]
                    return v

                kept = []
                for u, v in zip(a[i].tolist(), b[j].tolist(), strict=True):
                    p, q = find(u), find(v)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        kept.append((u, v))
                if kept:
                    yield pa.record_batch([pa.array([x for x, _ in kept]), pa.array([x for _, x in kept])], names=["a", "b"])

    return run


def near_links(texts: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b): links between different texts (tid, text) whose components are the classes of similarity `least` or more."""
    bands = materialize(texts.mapInArrow(_bands, "band long, tid long"), "bands")
    buckets = bands.groupBy("band").agg(F.min("tid").alias("leader"), F.max("tid").alias("other")).where("leader <> other")
    stars = materialize(bands.join(buckets.select("band", "leader"), "band").where("tid <> leader").select(F.col("tid").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    drop_table(bands)
    groups = components(stars, "groups").select(F.col("node").alias("tid"), F.col("label").alias("group"))
    # copies of a text are one before the exchange, in either order
    near = few(groups.select("tid"))
    members = texts.join(near, "tid", "left_semi").dropDuplicates(["tid"]) if groups.count() <= FEW else texts.dropDuplicates(["tid"]).join(near, "tid", "left_semi")
    sets = materialize(members.select("tid", "text").mapInArrow(_sets, "tid long, shingles binary, n long"), "sets")
    placed = groups.join(sets.select("tid", "n"), "tid")
    sizes = few(materialize(placed.groupBy("group").agg(F.count("*").alias("size"), F.sum("n").alias("total")), "sizes"))
    sized = materialize(placed.join(sizes, "group").withColumn("whole", (F.col("size") <= BLOCK) & (F.col("total") <= BLOCK_SHINGLES)), "sized")
    drop_table(groups)
    packed = F.collect_list(F.struct("tid", "shingles"))
    # small groups whole
    small = sized.where("whole").select("tid", "group").join(sets, "tid").groupBy("group").agg(packed.alias("x"))
    found = materialize(small.select("x", F.lit(None).cast("array<struct<tid:long,shingles:binary>>").alias("y")).mapInArrow(_links(least), "a long, b long"), "links")
    large = sized.where("NOT whole")
    if not large.limit(1).count():
        drop_table(stars, sets, sized)
        return found
    # large groups: each text with one other first
    stars = materialize(stars.join(few(large.select("tid")), F.col("a") == F.col("tid"), "left_semi"), "large-stars")
    popular = stars.groupBy("b").agg(F.count("*").alias("n"))
    nearest = stars.join(popular, "b").groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", "m.b")
    of = lambda c: sets.select(F.col("tid").alias(c), F.array(F.struct("tid", "shingles")).alias("x" if c == "a" else "y"))
    verified = materialize(nearest.join(of("a"), "a").join(of("b"), "b").select("x", "y").mapInArrow(_links(least), "a long, b long"), "verified")
    labels = components(verified, "verified")
    labelled = large.join(labels.select(F.col("node").alias("tid"), "label"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    labelled = materialize(labelled, "labelled")
    most = labelled.groupBy("group", "label").count().groupBy("group").agg(F.max(F.struct("count", "label")).alias("m")).select("group", F.col("m.label").alias("main"))
    # a place in its group: by hash ranges, so that no group is numbered in one task
    n_blocks = F.ceil(F.greatest(F.lit(1), F.col("size") * 2 / BLOCK, F.col("total") * 2 / BLOCK_SHINGLES))
    placed = labelled.join(most, "group").withColumn("blocks", n_blocks.cast("long"))
    placed = placed.select("tid", "group", "blocks", (F.col("label") != F.col("main")).alias("rest"), F.pmod(F.xxhash64("tid"), "blocks").alias("block"))
    every = placed.join(sets, "tid").groupBy("group", "block").agg(packed.alias("y"))
    # a block of the rest is sent to each block of its group
    rest = placed.where("rest").join(sets, "tid").groupBy("group", "blocks", "block").agg(packed.alias("x"))
    rest = rest.select("group", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    more = materialize(rest.join(every, ["group", "block"]).select("x", "y").mapInArrow(_links(least), "a long, b long"), "more-links")
    out = materialize(found.unionByName(verified).unionByName(more), "all-links")
    drop_table(stars, sets, sized, labels, labelled, found, verified, more)
    return out


def near_classes(df: DataFrame, least: float = 0.8, text_col: str = "text") -> DataFrame:
    """(tid, class_tid) for every text that has a near duplicate with a different text."""
    texts = df.select(F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    links = near_links(texts, least)
    classes = components(links, "classes")
    drop_table(links)
    return classes.select(F.col("node").alias("tid"), F.col("label").alias("class_tid"))


def near_duplicates(df: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): one row a document."""
    classes = near_classes(df, least, text_col)
    has_words = F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tid"), F.coalesce(has_words, F.lit(False)).alias("full"))
    docs = materialize(docs, "docs")
    per_text = docs.where("full").groupBy("tid").agg(F.min("doc_id").alias("first"))
    per_text = per_text.join(classes, "tid", "left").withColumn("class_tid", F.coalesce("class_tid", "tid"))
    per_class = per_text.groupBy("class_tid").agg(F.min("first").alias("class_id"))
    by_text = per_text.select("tid", "class_tid").join(per_class, "class_tid").select("tid", "class_id")
    full = docs.where("full").join(by_text, "tid").select("doc_id", "class_id")
    return full.unionByName(docs.where("not full").select("doc_id", F.col("doc_id").alias("class_id")))


def keep_one(df: DataFrame, least: float = 0.8) -> DataFrame:
    """df with one document of each class: the one with the least doc_id (null last), by a hash of the text where ids are equal. Rows without words all stay."""
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    last = F.lit((1 << 63) - 1)
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.xxhash64("text").alias("_tid"), F.coalesce(F.col("doc_id").cast("long"), last).alias("_doc"), has_words.alias("_full"))
    classes = near_classes(df.where(has_words).select("text"), least)
    per_text = whole.where("_full").groupBy("_tid").agg(F.min("_doc").alias("first")).join(classes, F.col("_tid") == F.col("tid"), "left").select("_tid", "first", F.coalesce("class_tid", "_tid").alias("class"))
    chosen = per_text.groupBy("class").agg(F.min(F.struct("first", "_tid")).alias("c")).select(F.col("c._tid").alias("c_tid"), F.col("c.first").alias("c_doc"))
    full = whole.where("_full").join(chosen, (F.col("_tid") == F.col("c_tid")) & (F.col("_doc") == F.col("c_doc"))).dropDuplicates(["_tid", "_doc"])
    return full.select("_row").unionByName(whole.where("NOT _full").select("_row")).select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns))

"""Exact top-k search with vector-approximation files.

Every vector lies in a block; a block stores, for each dimension, an even grid of cells and, for each vector, its cell
numbers (the approximation), apart from the exact components. A query scans the approximations only, which bound the
inner product of each vector from below and above. The k-th largest lower bound over all blocks is a threshold: a
vector whose upper bound is less cannot be a result. Of the others, exact components are read in the order of their
bounds, and the reading ends where no bound reaches the k-th exact score.

Null vectors and those with null or non-finite components take no part. Vectors are compared with those of their own
length. Scores are exact whatever the components' sizes: where 64 bits don't hold them, whole numbers of any length are used; the order is that
of the exact scores, and a score beyond the range of a long is given as the nearest long. An empty table gives an empty result; rows with the same id are rows of their own; columns besides the two named
are ignored. Ties go to the smaller id (null ids last).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize

_BLOCK = "block long, dim int, n int, rids binary, ids binary, low binary, step binary, codes binary"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_BOUND = "q_rid long, rid long, low double, high double, nth int"


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(rid, vec_id, v array<double>) of the vectors whose components are all finite."""
    good = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(good).select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * component): whole numbers as doubles, exact, or infinite beyond the range of a double."""
    with np.errstate(over="ignore"):
        return np.floor(scale * np.asarray(column.flatten(), np.float64).reshape(len(column), -1))


def _whole(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) > 2**53 else math.floor(scale * x)


def _place(score: int) -> bytes:
    """Bytes in the order of the scores beyond the range of a long on one side; none for others."""
    if _LEAST <= score <= _MOST:
        return b""
    size = (abs(score).bit_length() + 7) // 8
    data = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return data if score > 0 else bytes(255 - x for x in data)


def _exact(scale: int):
    """Inner products of q and v, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, place = np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows
            lengths = np.asarray(batch.column("v").value_lengths())
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                a, b = (_matrix(batch.column(c).take(pa.array(at)), scale) for c in ("qv", "v"))
                small = np.abs(a).max(1) * np.abs(b).max(1) * dim < 2.0**53
                score[at[small]] = np.einsum("ij,ij->i", a[small], b[small]).astype(np.int64)  # whole numbers below 2^53 at each step
                for i in at[~small].tolist():
                    x, y = batch.column("qv")[i].as_py(), batch.column("v")[i].as_py()
                    found = sum(_whole(p, scale) * _whole(q, scale) for p, q in zip(x, y, strict=True))
                    score[i], place[i] = max(_LEAST, min(_MOST, found)), _place(found)
            yield pa.record_batch([batch.column("q_rid"), batch.column("query_id"), batch.column("vec_id"), pa.array(score), pa.array(place, pa.binary())], names=["q_rid", "query_id", "vec_id", "score", "place"])

    return run


def _blocks(rows_per_block: int, cells: int, keep: int, scale: int):
    """Packs a partition's rows into blocks. Of equal vectors in a block only the keep first ids are candidates: the others can't be among the k best of anything."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(dim: int) -> pa.RecordBatch:
            rid, vid, v = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            order = np.lexsort((rid, vid, *v.T[::-1]))
            same = np.r_[False, (v[order][1:] == v[order][:-1]).all(1)] if len(v) else np.zeros(0, bool)
            run = np.arange(len(v)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(v))))
            rid, vid, v = (x[order[run < keep]] for x in (rid, vid, v))
            low = v.min(0)
            with np.errstate(all="ignore"):
                step = np.maximum((v.max(0) - low) / cells, 1e-9)
                codes = np.minimum(np.nan_to_num((v - low) / step, posinf=0, neginf=0), cells - 1).astype(np.uint8)
            row = [[int(rid[0])], [dim], [len(v)], [rid.tobytes()], [vid.tobytes()], [low.tobytes()], [step.tobytes()], [codes.tobytes()]]
            kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5)
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            lengths = np.asarray(batch.column("v").value_lengths())
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                vid = part.column("vec_id").fill_null(np.iinfo(np.int64).max)
                v = _matrix(part.column("v"), scale)
                for a in range(0, len(v), rows_per_block):
                    held.setdefault(int(dim), []).append((np.asarray(part.column("rid"))[a : a + rows_per_block], np.asarray(vid)[a : a + rows_per_block], v[a : a + rows_per_block]))
                    if sum(len(x[0]) for x in held[dim]) >= rows_per_block:
                        yield flush(int(dim))
        for dim in list(held):
            yield flush(dim)

    return pack


def _scan(k: int):
    """Bounds of a block of queries against a block of approximations: all vectors whose upper bound reaches the block's k-th lower bound; nth ranks the lower bounds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore", invalid="ignore")
        for batch in batches:
            for r in batch.to_pylist():
                dim, rids = r["dim"], np.frombuffer(r["rids"], np.int64)
                low, step = np.frombuffer(r["low"]), np.frombuffer(r["step"])
                codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, dim).astype(np.float64)
                q_rids, q = np.frombuffer(r["q_rids"], np.int64), np.frombuffer(r["q"]).reshape(-1, dim)
                reach = np.maximum(np.abs(low), np.abs(low + codes.max(0, initial=0) * step + step)) if len(codes) else np.abs(low)
                out: list[list[np.ndarray]] = []
                for a in range(0, len(q), 256):
                    part, own = q[a : a + 256], q_rids[a : a + 256]
                    middle = (part @ (low + step / 2))[:, None] + (part * step) @ codes.T
                    # half a cell, and what rounding may do to a sum of such terms
                    slack = (np.abs(part) @ step)[:, None] / 2 + (dim + 8) * 1e-15 * (np.abs(part) @ reach)[:, None] + 1e-6
                    lows, highs = middle - slack, middle + slack
                    unknown = ~(np.isfinite(lows) & np.isfinite(highs))  # beyond the range of a double: read exactly
                    lows[unknown], highs[unknown] = -np.inf, np.inf
                    mine = own[:, None] == rids[None, :]
                    lows[mine] = highs[mine] = -np.inf
                    kth = np.partition(lows, -k, axis=1)[:, -k] if lows.shape[1] > k else np.full(len(part), -np.inf)
                    i, j = np.nonzero((highs >= kth[:, None]) & ~mine)
                    order = np.lexsort((-lows[i, j], i))
                    i, j = i[order], j[order]
                    nth = np.arange(len(i)) - np.searchsorted(i, i)
                    out.append([own[i], rids[j], lows[i, j], highs[i, j], nth.astype(np.int32)])
                if out:
                    yield pa.record_batch([np.concatenate(x) for x in zip(*out, strict=True)], names=[x.split()[0] for x in _BOUND.split(", ")])

    return scan


def _pack_queries(rows_per_block: int, scale: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("v").value_lengths())
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                rid, v = np.asarray(part.column("rid")), _matrix(part.column("v"), scale)
                for a in range(0, len(v), rows_per_block):
                    yield pa.record_batch([pa.array([int(dim)], pa.int32()), pa.array([rid[a : a + rows_per_block].tobytes()]), pa.array([v[a : a + rows_per_block].tobytes()])], names=["q_dim", "q_rids", "q"])

    return pack


def exact_top_k(df: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", rows_per_block: int = 8192, cells: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows other than the query's own for each row where is_query (a Column over vec_id) holds.

    Queries meet the approximations block by block: a block pair is one row of a join on the vectors' length, so work is
    queries x vectors as asked for, while what moves is packed blocks. Equal vectors cost one cell scan and k + 1 ids a block.
    """
    spark = df.sparkSession
    vectors = materialize(usable_vectors(df, id_col, vector_col), "vectors")
    queries = vectors.where(is_query)
    n = max(1, spark.sparkContext.defaultParallelism)
    approx = materialize(vectors.mapInArrow(_blocks(rows_per_block, cells, k + 1, scale), _BLOCK), "approximations")
    # every query block is sent to each of the groups of approximation blocks
    packed = queries.mapInArrow(_pack_queries(1024, scale), "q_dim int, q_rids binary, q binary").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    placed = approx.withColumn("place", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int"))
    pairs = placed.join(packed, (placed["place"] == packed["place"]) & (placed["dim"] == packed["q_dim"])).select("dim", "rids", "low", "step", "codes", "q_rids", "q")
    bounds = materialize(pairs.mapInArrow(_scan(k), _BOUND), "bounds")
    best_low = Window.partitionBy("q_rid").orderBy(F.desc("low"))
    kth = bounds.where(F.col("nth") < k).withColumn("i", F.row_number().over(best_low)).where(F.col("i") == k).select("q_rid", F.col("low").alias("least"))
    alive = bounds.join(kth, "q_rid", "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("q_rid", "rid", "high")
    ordered = materialize(alive.withColumn("turn", F.row_number().over(Window.partitionBy("q_rid").orderBy(F.desc("high")))), "ordered")
    right = vectors.select("rid", "vec_id", "v")
    left = queries.select(F.col("rid").alias("q_rid"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))

    def read(turns: DataFrame) -> DataFrame:
        return turns.join(right, "rid").join(left, "q_rid").select("q_rid", "query_id", "vec_id", "qv", "v").mapInArrow(_exact(scale), "q_rid long, query_id long, vec_id long, score long, place binary")

    first = materialize(read(ordered.where(F.col("turn") <= 2 * k)), "read")
    by_score = Window.partitionBy("q_rid").orderBy(F.desc("score"), F.desc("place"), F.asc_nulls_last("vec_id"))
    kth_read = first.withColumn("i", F.row_number().over(by_score)).where(F.col("i") == k)
    certain = kth_read.where(F.col("score") > _LEAST).select("q_rid", F.col("score").alias("sure"))
    rest = ordered.where(F.col("turn") > 2 * k).join(certain, "q_rid", "left").where(F.col("sure").isNull() | (F.col("high") >= F.col("sure")))
    ranked = first.unionByName(read(rest)).withColumn("rank", F.row_number().over(by_score))
    result = materialize(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ranked")
    drop_table(vectors, approx, bounds, ordered, first)
    return result

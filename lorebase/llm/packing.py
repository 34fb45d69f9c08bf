"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Only documents longer than a sequence are cut; the first piece is then the shorter one. A round range-sorts what is left,
pieces by length and open sequences by gap, from large to small, and sweeps each range from its start: a piece takes
the smallest gap seen so far that holds it (its successor), and what remains of the gap is offered again. Pieces that find none in
their own range take, by rank, gaps that ranges before it have left, nearest first; those ranges hold only larger
sizes, so any of these fits. That pairing works on counts of the ranges (one row a range), so a round costs one sort and
one join, each even over the tasks whatever the lengths' distribution. Where the pieces still left need more room than all gaps have, or
none was paired, the largest open new sequences. Rounds go on until no piece is left; each of them places some. Ranges are of one size, so what is left has
fewer of them round by round.

Null texts are empty: a document of the end id alone. Null and repeated ids are allowed, each row is a document; an empty
table gives no rows. Columns besides the two named are ignored by pack_documents() and kept by pack_rows().
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, materialize
from .encoding import encoder
from .words import slices

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_STATE = "kind int, size long, uid long, doc_id long, piece int, start long, ids_crc32 long, seq long, offset long"
_SWEPT = f"{_STATE}, part int, nth long"
_NAMES = [x.split()[0] for x in _SWEPT.split(", ")]
#: Rows that one range has about.
RANGE_ROWS = 25_000
#: The least ranges of the first round, and the most of any: the list of ranges goes through the driver, so beyond that ranges grow.
FIRST_RANGES, MOST_RANGES = 8, 20_000
#: Kinds of rows: what is placed, a piece to be placed, a sequence with a gap.
_PLACED, _PIECES, _GAPS = 0, 1, 2


def _cutter(tokenizer: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer)
        end = np.uint32(end_id).tobytes()
        for whole in batches:
            for batch in slices(whole, "text"):
                rows: list[tuple] = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), codes.texts(batch.column("text").to_pylist()), strict=True):
                    data = memoryview(np.frombuffer(ids + end, np.uint32).astype("<u4").tobytes())
                    total = len(data) // 4
                    first = (total - 1) % capacity + 1
                    cuts = [0, *range(first, total + 1, capacity)]
                    rows += [(doc_id, i, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PIECE.split(", ")])

    return cut


def pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's pieces."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_cutter(tokenizer, end_id, capacity), _PIECE)


def _sweep(capacity: int):
    """One range, from large to small."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.concat_tables(tables).combine_chunks()
        kind, size, uid, seq, offset = (t.column(c).fill_null(-1).to_numpy().copy() for c in ("kind", "size", "uid", "seq", "offset"))
        sizes: list[int] = []  # of gaps, in order
        gaps: dict[int, list[int]] = {}  # the sequences that have a gap of each size
        nth = np.full(len(size), -1, np.int64)
        n_left = 0

        def offer(gap: int, s: int) -> None:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append(s)

        for i in range(len(size)):
            n = int(size[i])
            if kind[i] == _GAPS:
                offer(n, int(seq[i]))
                continue
            at = bisect_left(sizes, n)
            if at < len(sizes):
                gap = sizes[at]
                s = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                nth[i], n_left = n_left, n_left + 1
                continue
            kind[i], seq[i], offset[i] = _PLACED, s, capacity - gap
            if gap > n:
                offer(gap - n, s)
        least = int(size[-1])
        keep = np.flatnonzero(kind != _GAPS)
        out = t.take(keep)
        names = {"kind": kind, "seq": seq, "offset": offset, "nth": nth}
        for name in ("kind", "seq", "offset"):
            values = names[name][keep]
            out = out.set_column(out.schema.get_field_index(name), name, pa.array(values, t.schema.field(name).type, mask=None if name == "kind" else values < 0))
        out = out.append_column("part", pa.array(np.full(len(keep), part, np.int32))).append_column("nth", pa.array(nth[keep]))
        yield from out.select(_NAMES).combine_chunks().to_batches()
        if gaps:
            # gaps that hold any piece of later ranges are ranked, smallest first
            size_left = np.array([g for g in sizes for _ in gaps[g]], np.int64)
            ranks = np.where(size_left >= least, np.arange(len(size_left)) - int(np.searchsorted(size_left, least)), -1)
            n = len(size_left)
            none = pa.nulls(n, pa.int64())
            columns = {"kind": pa.array(np.full(n, _GAPS, np.int32)), "size": pa.array(size_left), "piece": pa.nulls(n, pa.int32()), "seq": pa.array([s for g in sizes for s in gaps[g]]), "part": pa.array(np.full(n, part, np.int32)), "nth": pa.array(ranks)}
            yield pa.record_batch([columns.get(c, none) for c in _NAMES], names=_NAMES)

    return sweep


def _pair_ranges(counts: list, capacity: int) -> tuple[list[tuple], list[tuple]]:
    """From (part, pieces, mean length, ranked gaps, room) of each range in order: runs of pieces that take runs of earlier ranges' gaps
    (part, from, to, gap part, first gap), and runs that open sequences (part, from, to)."""
    links: list[tuple] = []
    stack: list[tuple[int, int, int]] = []
    short: list[tuple[int, int, int, float]] = []
    for part, n_pieces, mean, n_gaps, _ in counts:
        done = 0
        while done < n_pieces and stack:
            q, first, n = stack.pop()
            m = min(n, n_pieces - done)
            links.append((part, done, done + m, q, first))
            done += m
            if m < n:
                stack.append((q, first + m, n - m))
        if done < n_pieces:
            short.append((part, done, n_pieces, mean))
        if n_gaps:
            stack.append((part, 0, n_gaps))
    need = sum((b - a) * mean for _, a, b, mean in short) - sum(x[4] for x in counts)
    new = max(0, -int(-need // capacity))
    if not new and not links and short:  # the room there is fits none of them: half of what their tokens need is opened
        new = -int(-sum((b - a) * mean for _, a, b, mean in short) // (2 * capacity))
    opened = []
    for part, a, b, _ in short:
        if new > 0:
            opened.append((part, a, min(b, a + new)))
            new -= min(b - a, new)
    return links, opened


def pack_rows(pieces_df: DataFrame, capacity: int) -> DataFrame:
    """pieces_df's rows (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces_df.sparkSession
    state = pieces_df.select(F.lit(_PIECES).alias("kind"), F.col("length").alias("size"), F.monotonically_increasing_id().alias("uid"), "doc_id", "piece", "start", "ids_crc32", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("offset"))
    state = materialize(state, "pieces")
    # two pieces above half the capacity never share a sequence: each opens one
    opens = F.col("size") > capacity // 2
    names = _NAMES[:-2]
    done = [state.where(opens).withColumns({"kind": F.lit(_PLACED), "seq": F.col("uid"), "offset": F.lit(0).cast("long")}).select(names)]
    gap_of = lambda df, size: df.select(F.lit(_GAPS).alias("kind"), size.alias("size"), *(F.lit(None).cast("int" if c == "piece" else "long").alias(c) for c in names[2:-2]), F.col("seq"), F.lit(None).cast("long").alias("offset"))
    state = state.where(~opens).unionByName(gap_of(state.where(opens & (F.col("size") < capacity)).withColumn("seq", F.col("uid")), F.lit(capacity) - F.col("size")))
    rounds = 0
    while True:
        found = state.groupBy().agg(F.count(F.when(F.col("kind") == _PIECES, 1)).alias("pieces"), F.count("*").alias("rows"), F.min(F.when(F.col("kind") == _PIECES, F.col("size"))).alias("least")).first()
        if not found["pieces"]:
            break
        state = state.where((F.col("kind") == _PIECES) | (F.col("size") >= found["least"]))  # other gaps stay as they are
        order = [F.desc("size"), F.desc("kind"), F.xxhash64("uid", "seq")]
        ranges = min(MOST_RANGES, max(1 if rounds else FIRST_RANGES, -(-found["rows"] // RANGE_ROWS)))
        rounds += 1
        dealt = state.repartitionByRange(ranges, *order) if ranges > 1 else state.coalesce(1)  # one range, of RANGE_ROWS rows at most, needs no boundaries
        swept = materialize(dealt.sortWithinPartitions(*order).mapInArrow(_sweep(capacity), _SWEPT), "swept")
        done.append(swept.where(F.col("kind") == _PLACED).select(names))
        counts = swept.where(F.col("kind") != _PLACED).groupBy("part").agg(
            F.count(F.when(F.col("kind") == _PIECES, 1)).alias("p"), F.coalesce(F.avg(F.when(F.col("kind") == _PIECES, F.col("size"))), F.lit(0.0)).alias("m"),
            F.count(F.when((F.col("kind") == _GAPS) & (F.col("nth") >= 0), 1)).alias("g"), F.coalesce(F.sum(F.when(F.col("kind") == _GAPS, F.col("size"))), F.lit(0)).alias("room"))
        links, opened = _pair_ranges(sorted((r["part"], r["p"], r["m"], r["g"], r["room"]) for r in counts.collect()), capacity)
        runs = spark.createDataFrame([(p, a, b, q, c) for p, a, b, q, c in links] + [(p, a, b, -1, 0) for p, a, b in opened], "r_part int, r_from long, r_to long, r_gaps int, r_first long")
        # each range begins and ends few runs, and there are MOST_RANGES ranges at most
        runs = few(runs)
        left = swept.where(F.col("kind") == _PIECES).join(runs, (F.col("part") == F.col("r_part")) & (F.col("nth") >= F.col("r_from")) & (F.col("nth") < F.col("r_to")), "left")
        takes = left.where(F.col("r_gaps") >= 0).select(F.col("r_gaps").alias("t_part"), (F.col("r_first") + F.col("nth") - F.col("r_from")).alias("t_nth"), F.struct(*names).alias("taker"))
        gaps = swept.where(F.col("kind") == _GAPS)
        met = gaps.join(takes, (gaps["part"] == takes["t_part"]) & (gaps["nth"] == takes["t_nth"]), "left")
        now = materialize(
            met.select("size", "seq", "taker", F.lit(False).alias("opens"))
            .unionByName(left.where(F.col("r_gaps").isNull() | (F.col("r_gaps") < 0)).select(F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("seq"), F.struct(*names).alias("taker"), F.coalesce(F.col("r_gaps") < 0, F.lit(False)).alias("opens"))), "met")
        flat = now.select("size", "seq", "opens", *(F.col(f"taker.{c}").alias(f"x_{c}") for c in names))
        is_gap, taken = F.col("size").isNotNull(), F.col("x_kind").isNotNull()
        piece = {c: F.col(f"x_{c}") for c in names}
        put = lambda df, **more: df.select(*((piece | more)[c].alias(c) for c in names))
        done.append(put(flat.where(is_gap & taken), kind=F.lit(_PLACED), seq=F.col("seq"), offset=F.lit(capacity) - F.col("size")))
        done.append(put(flat.where(F.col("opens")), kind=F.lit(_PLACED), seq=F.col("x_uid"), offset=F.lit(0).cast("long")))
        grown = flat.where(is_gap).withColumn("size", F.col("size") - F.coalesce("x_size", F.lit(0)))
        fresh = flat.where(F.col("opens")).withColumns({"seq": F.col("x_uid"), "size": F.lit(capacity) - F.col("x_size")})
        state = put(flat.where(~is_gap & ~F.col("opens"))).unionByName(gap_of(grown.unionByName(fresh).where("size > 0").select("size", "seq"), F.col("size")))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select("doc_id", "piece", "start", F.col("size").alias("length"), "ids_crc32", F.col("seq").alias("sequence_id"), "offset")


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    return pack_rows(pieces(df, tokenizer, end_id, capacity), capacity)

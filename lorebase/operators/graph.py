"""Bounded searches of the evidence graph over an adjacency layout.

The layout has each edge twice, by source and by target, in folders by the hash of that end, sorted by it; a row names that end and the far one. A round
of a search reads the folders of its frontier's ids and no others. The layout is written in turns of some folders each, so that what is shuffled at a
time is a share of it. Each round takes at most limit edges, newest first, as the reference behaviour has it, so what is held on the way is bounded by
rounds x limit, whatever the graph; ids go by their canonical form through the aliases.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import clamp
from ..schema import Tables
from ..sources.shared import no_shuffle_files_left
from .read import between, overlapping

#: Rows that a folder has about, and the most folders of a direction; the least and greatest number of folders' files is up to the write.
ROWS_PER_BUCKET, MOST_BUCKETS = 500_000, 4096
#: Edges that are shuffled in a turn about, and the most turns: each reads the edges once more.
EDGES_PER_TURN, MOST_TURNS = 8_000_000, 8
#: Default and greatest number of edges a round, and of alias rows a lookup.
LIMIT, MOST, MOST_ALIASES = 100, 10_000, 10_000
#: Columns of an edge besides its ends.
_BESIDES = ["cluster_id", "edge_type", "src_kind", "dst_kind", "valid_from", "valid_to"]
_EDGE = ["edge_type", "src_id", "dst_id", "src_kind", "dst_kind", "valid_from", "valid_to"]


@dataclass(frozen=True)
class Adjacency:
    """Edges of a folder by either end."""

    spark: SparkSession
    folder: str
    buckets: int
    schema: StructType  # of the edges

    @staticmethod
    def build(edges: DataFrame, folder: str, buckets: int | None = None, rows: int | None = None) -> Adjacency:
        """Writes the layout: the edges by source, then from these files the same by target. rows: the number of edges, counted where it isn't given."""
        rows = edges.count() if rows is None and buckets is None else rows or 0
        if buckets is None:
            buckets = max(16, min(MOST_BUCKETS, rows // ROWS_PER_BUCKET))
        graph = Adjacency(edges.sparkSession, folder, buckets, edges.select("cluster_id", *_EDGE).schema)
        graph._write(edges, "out", rows)
        stored = graph.spark.read.schema(graph._stored()).parquet(f"{folder}/direction=out")
        graph._write(stored.select(*_BESIDES, F.col("near_id").alias("src_id"), F.col("far_id").alias("dst_id")), "in", rows)
        return graph

    def _write(self, edges: DataFrame, direction: str, rows: int) -> None:
        """Edges by one end. A turn writes the folders of its own ids and its shuffle files go as it ends. Spark splits what is dealt to a task where an id is hot."""
        near, far = ("src_id", "dst_id") if direction == "out" else ("dst_id", "src_id")
        turns = max(1, min(MOST_TURNS, rows // EDGES_PER_TURN))
        tasks = rows // turns // ROWS_PER_BUCKET
        half = edges.select(*_BESIDES, F.col(near).alias("near_id"), F.col(far).alias("far_id"), self._of(F.col(near), self.buckets).alias("bucket"))
        with no_shuffle_files_left(self.spark):
            for turn in range(turns):
                mine = half.where(F.col("bucket") % turns == turn) if turns > 1 else half
                spread_out = mine.hint("rebalance", tasks, "bucket") if tasks > 8 else mine.hint("rebalance", "bucket")
                spread_out.sortWithinPartitions("bucket", "near_id").write.mode("append" if turn else "error").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.folder}/direction={direction}")  # sorted, so ranges tell where an id is

    def _stored(self) -> StructType:
        ids = [StructField(n, StringType()) for n in ("near_id", "far_id")]
        return StructType([*(self.schema[c] for c in _BESIDES), *ids])

    @staticmethod
    def _of(near: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(near), F.lit(buckets)).cast("int")

    def touching(self, ids: list[str], cluster_id: str = "") -> DataFrame:
        """Edges that touch any of the ids, once for each end that does. Folders of other ids aren't read."""
        wanted = self.spark.createDataFrame([(i,) for i in ids], "near_id string")
        folders = sorted(r[0] for r in wanted.select(self._of(F.col("near_id"), self.buckets)).distinct().collect())
        stored = self.spark.read.schema(self._stored().add("direction", "string").add("bucket", "integer")).parquet(self.folder)
        out = F.col("direction") == "out"
        ends = [F.when(out, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("near_id", "far_id", "src_id"), ("far_id", "near_id", "dst_id"))]
        found = stored.where(F.col("bucket").isin(folders) & F.col("near_id").isin(ids)).select(*_BESIDES, *ends, "near_id", "direction", "bucket")
        return found.where(F.col("cluster_id") == cluster_id) if cluster_id else found


def _known(aliases: DataFrame | None, ids: list[str]) -> tuple[set[str], set[str], dict[str, str], dict[str, str]]:
    """(canonical ids, ids to search by, canonical id of each alias, kind of each id) around ids."""
    canonical, search, of, kinds = set(ids), set(ids), {i: i for i in ids}, {}
    if aliases is not None and ids:
        rows = aliases.where(F.col("object_id").isin(ids) | F.col("alias_id").isin(ids)).select("object_id", "alias_id", "kind").distinct()
        for r in rows.orderBy("object_id", "alias_id", "kind").limit(MOST_ALIASES).collect():  # at most MOST_ALIASES rows
            canonical.add(r["object_id"])
            search |= {r["object_id"], r["alias_id"]}
            of[r["object_id"]] = r["object_id"]
            of[r["alias_id"]] = r["object_id"]
            if r["kind"]:
                kinds[r["object_id"]] = r["kind"]
    return canonical, search, of, kinds


def search_edges(graph: Adjacency, roots: list[str], limit: int = LIMIT, rounds: int = 3, aliases: DataFrame | None = None, start: datetime | None = None, end: datetime | None = None, cluster_id: str = "") -> DataFrame:
    """(edge_type, src_id, dst_id, src_kind, dst_kind, valid_from, valid_to) around roots: each round takes the newest limit edges that touch what has been
    reached, until a round reaches nothing new. Ends are canonical. Edges of equal time go by type, source and target."""
    limit = clamp(limit, LIMIT, MOST)
    order = [F.col("valid_from").desc_nulls_last(), F.col("edge_type"), F.col("src_id"), F.col("dst_id")]
    found: dict[tuple, tuple] = {}
    reached = set(roots)
    for _ in range(rounds):
        _, search, _, _ = _known(aliases, sorted(reached))
        near = overlapping(graph.touching(sorted(search), cluster_id).select("cluster_id", *_EDGE).distinct(), start, end)
        rows = near.orderBy(*order).limit(limit).collect()  # at most limit rows
        found |= {tuple(r[c] for c in ("edge_type", "src_id", "dst_id", "valid_from", "valid_to")): tuple(r[c] for c in _EDGE) for r in rows}
        canonical, _, of, _ = _known(aliases, sorted({x for r in found.values() for x in (r[1], r[2])} | reached))
        now = {of.get(i, i) for i in canonical}
        if now == reached:
            break
        reached = now
    _, _, of, kinds = _known(aliases, sorted({x for r in found.values() for x in (r[1], r[2])} | reached))
    turned = []
    for edge_type, src, dst, src_kind, dst_kind, *times in found.values():
        src, dst = of.get(src, src), of.get(dst, dst)
        turned.append((edge_type, src, dst, kinds.get(src) or src_kind, kinds.get(dst) or dst_kind, *times))
    return graph.spark.createDataFrame(sorted(set(turned), key=str), StructType([graph.schema[c] for c in _EDGE]))


def service_evidence(tables: Tables, graph: Adjacency, namespace: str, name: str, cluster_id: str = "", limit: int = LIMIT, start: datetime | None = None, end: datetime | None = None) -> dict[str, DataFrame]:
    """Service, edges, objects, facts and changes around a service, each of at most limit rows, newest first, and a summary of their numbers."""
    if not namespace or not name:
        raise ValueError("a service is asked for by namespace and name")
    limit = clamp(limit, LIMIT, MOST)
    versions = between(tables["versions"], "observed_at", start, end)
    who = ["cluster_id", "object_id", "kind", "namespace", "name", "uid"]
    asked = (F.col("kind") == "Service") & (F.col("namespace") == namespace) & (F.col("name") == name)
    service = versions.where(asked & (F.col("cluster_id") == cluster_id) if cluster_id else asked).groupBy(*who).agg(F.max("observed_at").alias("last_observed_at")).orderBy(F.desc("last_observed_at"), "object_id").limit(10)
    roots = [r["object_id"] for r in service.collect()]
    edges = search_edges(graph, roots, limit, aliases=tables.get("object_aliases"), start=start, end=end, cluster_id=cluster_id)
    ids = sorted({*roots, *(x for r in edges.select("src_id", "dst_id").collect() for x in r)})  # at most two an edge
    mine = F.col("object_id").isin(ids)
    out = {
        "service": service, "edges": edges,
        "objects": versions.where(mine).groupBy(*who).agg(F.max("observed_at").alias("last_observed_at")).orderBy(F.desc("last_observed_at"), "object_id").limit(limit),
        "facts": between(tables["facts"], "ts", start, end).where(mine).select("ts", "object_id", "kind", "namespace", "name", "fact_key", "fact_value", "severity").orderBy(F.desc("ts"), "object_id", "fact_key", "fact_value").limit(limit),
        "changes": between(tables["changes"], "ts", start, end).where(mine).select("ts", "object_id", "kind", "namespace", "name", "change_family", "path", "op", "old_scalar", "new_scalar", "severity").orderBy(F.desc("ts"), "object_id", "path").limit(limit),
    }
    counts = [F.lit(len(roots)).alias("services"), *(F.lit(out[t].count()).alias(t) for t in ("objects", "facts", "edges", "changes"))]
    return out | {"summary": service.sparkSession.range(1).select(*counts)}

"""Evidence tables under one folder, a batch of all of them committed at once.

A batch writes its data files below names of its own, then one manifest, which a rename puts in place; the rename fails where the batch's
manifest is there already. Readers take what manifests name and nothing else, so a batch that died half-way is invisible, and one that
runs again leaves one copy. One writer at a time; readers need no lock.

Append tables get a new folder each batch, by month, sorted by object with a bloom filter on its id. Keyed tables (KEYED) hold one
row a key, dealt over buckets by the key's hash. A batch reads and writes anew only the buckets that its keys fall into, and a
manifest maps each bucket to its newest folder. So what a batch reads follows its keys and not the batches before it. Buckets are doubled when they
hold more than ROWS_PER_BUCKET rows on average.

    _commits/<batch>.<step>.json        {"batch", "append": {table: [folder]}, "base": {table: [folders]}, "keyed": {table: {"buckets", "at": {bucket: [folder, rows]}}}}
    <table>/batch=<n>/attempt=<a>/month=<m>/...      <table>/batch=<n>/attempt=<a>/bucket=<b>/...

Steps after 0 are maintenance: a "base" replaces all folders of a table that came before. Every FOLD batches a manifest carries the
bases of all tables, so a reader opens at most FOLD manifests.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import moment
from ..schema import PARTITIONED, TABLES

FOLD = 50
BUCKETS, ROWS_PER_BUCKET = 16, 2_000_000


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows instead of old ones of their key; those marked deleted go."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new).where(~F.col("deleted"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows instead of old ones of their key; deletion is something that a row knows."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def added(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of both, with first and last times."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum("decisions").alias("decisions"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def newest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the newest observed_at of each key; ties go to the larger object id."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("observed_at", "object_id")).alias("n")).select(*keys, "n.*")


@dataclass(frozen=True)
class Keyed:
    """A table with a row a key, and how a batch's rows (one a key) go into it."""

    schema: str
    keys: tuple[str, ...]
    merge: Callable[[DataFrame, DataFrame, list[str]], DataFrame]

    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).names

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")


_OBJECT = ("cluster_id", "object_id")
KEYED: dict[str, Keyed] = {
    "object_state": Keyed("cluster_id string, object_id string, seq bigint, doc_hash string, deleted boolean", _OBJECT, upserted),
    "latest_raw": Keyed("cluster_id string, object_id string, kind string, namespace string, name string, observed_at timestamp, doc string, deleted boolean", _OBJECT, replaced),
    "canonical_ids": Keyed("cluster_id string, alias_id string, object_id string, observed_at timestamp", ("cluster_id", "alias_id"), newest),
    "filter_rollup": Keyed("hour timestamp, cluster_id string, filter_name string, outcome string, reason string, decisions bigint, first_at timestamp, last_at timestamp", ("hour", "cluster_id", "filter_name", "outcome", "reason"), added),
}


def month_bounds(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """df without months outside of a time range, so that their folders are never listed nor read."""
    df = df if start is None else df.where(F.col("month") >= f"{start:%Y-%m}")
    return df if end is None else df.where(F.col("month") <= f"{end:%Y-%m}")


class Store:
    """The tables of a folder. schemas adds append tables of other schemas, by name."""

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, str] | None = None, keyed: Mapping[str, Keyed] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas, self.keyed = {**TABLES, **(schemas or {})}, {**KEYED, **(keyed or {})}
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # manifests

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("_commits").getFileSystem(self._conf)

    def manifests(self) -> list[tuple[int, int]]:
        """(batch, step) of all commits, in order."""
        fs = self._fs()
        if not fs.exists(self._path("_commits")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path("_commits"))]
        return sorted((int(a), int(b)) for a, b, *_ in (n.split(".") for n in names if n.endswith(".json") and not n.startswith((".", "_"))))

    def _load(self, commit: tuple[int, int]) -> dict:
        stream = self._fs().open(self._path(f"_commits/{commit[0]:012d}.{commit[1]:04d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last_batch(self) -> int | None:
        """The newest committed batch."""
        commits = self.manifests()
        return commits[-1][0] if commits else None

    def state(self) -> tuple[dict[str, list[str]], dict[str, dict]]:
        """(folders of each append table, buckets of each keyed table) as of the newest commit."""
        append: dict[str, list[str]] = {}
        keyed: dict[str, dict] = {}
        newer: list[dict] = []
        for commit in reversed(self.manifests()):
            newer.append(self._load(commit))
            if newer[-1].get("folded"):
                break
        for m in reversed(newer):
            append |= m.get("base", {})
            for table, folders in m.get("append", {}).items():
                append[table] = append.get(table, []) + folders
            keyed |= m.get("keyed", {})
        return append, keyed

    def _put(self, commit: tuple[int, int], manifest: dict) -> bool:
        """Writes a manifest under another name and renames it; False where there is one already."""
        jvm = self._jvm
        temporary, final = self._path(f"_commits/.{uuid.uuid4().hex}"), self._path(f"_commits/{commit[0]:012d}.{commit[1]:04d}.json")
        out = self._fs().create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temporary, final, options)
        except Exception as e:
            self._fs().delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    # writing

    def commit(self, batch: int, tables: Mapping[str, DataFrame]) -> bool:
        """Commits a batch of tables, append and keyed ones; False, and nothing written, where it is committed already."""
        commits = self.manifests()
        if commits and batch <= commits[-1][0]:
            return False
        manifest: dict = {"batch": batch, "append": {}, "keyed": {}}
        append, keyed = self.state()
        for name, df in tables.items():
            if name in self.keyed:
                manifest["keyed"][name] = self._merge(name, df, batch, keyed.get(name))
            else:
                manifest["append"][name] = [self._append(name, df, batch)]
        if (len(commits) + 1) % FOLD == 0:
            manifest["base"] = {n: append.get(n, []) + manifest["append"].get(n, []) for n in {*append, *manifest["append"]}}
            manifest["keyed"] = keyed | manifest["keyed"]
            manifest |= {"append": {}, "folded": True}
        return self._put((batch, 0), manifest)

    def replace(self, tables: Mapping[str, DataFrame]) -> bool:
        """Maintenance: puts these append tables in place of what they hold now; their rows are written before anything goes."""
        commits = self.manifests()
        if not commits:
            return False
        batch, step = commits[-1]
        base = {name: [self._append(name, df, batch)] for name, df in tables.items()}
        return self._put((batch, step + 1), {"batch": batch, "base": base})

    def _columns(self, name: str) -> list[str]:
        return StructType.fromDDL(self.schemas[name]).names

    def _append(self, name: str, df: DataFrame, batch: int) -> str:
        folder = f"{name}/batch={batch}/attempt=a{uuid.uuid4().hex[:12]}"
        df = df.select(*self._columns(name))
        order = [c for c in ("object_id", "src_id", "cluster_id", "resource") if c in df.columns][:1]
        if when := PARTITIONED.get(name):
            df, order = df.withColumn("month", F.date_format(when, "yyyy-MM")), ["month", *order, when]
        writer = (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite")
        for c in ("object_id", "src_id", "dst_id"):
            if c in df.columns:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        (writer.partitionBy("month") if when else writer).parquet(f"{self.root}/{folder}")
        return folder

    def _merge(self, name: str, new: DataFrame, batch: int, at: dict | None) -> dict:
        table, at = self.keyed[name], at or {"buckets": BUCKETS, "at": {}}
        rows = sum(n for _, n in at["at"].values())
        buckets = at["buckets"]
        while rows > ROWS_PER_BUCKET * buckets:
            buckets *= 2
        new = new.select(*table.columns())
        touched = sorted(at["at"]) if buckets != at["buckets"] else [str(r[0]) for r in new.select(table.bucket(buckets)).distinct().collect()]  # at most one a bucket
        merged = table.merge(self._buckets(name, at, touched), new, list(table.keys)).withColumn("bucket", table.bucket(buckets))
        folder = f"{name}/batch={batch}/attempt=a{uuid.uuid4().hex[:12]}"
        merged.repartition(min(buckets, max(1, len(touched))), "bucket").sortWithinPartitions("bucket", *table.keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        schema = f"{table.schema}, bucket int"
        sizes = {str(b): [folder, n] for b, n in self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").groupBy("bucket").agg(F.count("*")).collect()}
        kept = {} if buckets != at["buckets"] else {b: x for b, x in at["at"].items() if b not in touched}
        return {"buckets": buckets, "at": kept | sizes}

    # reading

    def _buckets(self, name: str, at: dict, wanted: list[str]) -> DataFrame:
        paths = [f"{self.root}/{at['at'][b][0]}/bucket={b}" for b in wanted if b in at["at"]]
        return self.spark.read.schema(self.keyed[name].schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.keyed[name].schema)

    def touched(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of a keyed table's buckets that keys fall into: what a merge with these keys reads."""
        table, at = self.keyed[name], self.state()[1].get(name)
        if at is None:
            return self.spark.createDataFrame([], table.schema)
        return self._buckets(name, at, [str(r[0]) for r in keys.select(table.bucket(at["buckets"])).distinct().collect()])

    def read(self, name: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """A table as of the newest commit; of a table by month, with a time range only the folders of its months."""
        append, keyed = self.state()
        if name in self.keyed:
            at = keyed.get(name, {"at": {}})
            out = self._buckets(name, at, sorted(at["at"]))
            return out.drop("deleted") if self.keyed[name].merge is replaced else out
        if not append.get(name):
            return self.spark.createDataFrame([], self.schemas[name])
        when = PARTITIONED.get(name)
        schema = f"{self.schemas[name]}, batch int, attempt string" + (", month string" if when else "")
        df = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*(f"{self.root}/{x}" for x in append[name]))
        if when:
            df = month_bounds(df, start, end)
            df = df if start is None else df.where(F.col(when) >= moment(df, when, start))
            df = df if end is None else df.where(F.col(when) <= moment(df, when, end))
        return df.select(*self._columns(name))

    def compact(self, *names: str, files: int = 8) -> bool:
        """M3: append tables in one folder each, with few files."""
        return self.replace({n: self.read(n).repartition(files) for n in names})

    def vacuum(self) -> list[str]:
        """Removes folders that no table is read from: of batches that died, and of those that have been replaced. No batch may be under way."""
        append, keyed = self.state()
        live = {x for xs in append.values() for x in xs} | {f for t in keyed.values() for f, _ in t["at"].values()}
        fs, gone = self._fs(), []
        for table in (*self.schemas, *self.keyed):
            for status in fs.globStatus(self._path(f"{table}/batch=*/attempt=*")) or []:
                folder = "/".join(str(status.getPath()).rsplit("/", 3)[1:])
                if folder not in live:
                    fs.delete(status.getPath(), True)
                    gone.append(folder)
        return gone

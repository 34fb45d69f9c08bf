"""Writing evidence tables (K1, K2, K5, K6) and result formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import PARTITIONED, TABLES
from .store import Store

#: The order in which write_batch writes a batch's tables. It isn't atomic over tables (store.Store is); a rerun replaces its own files.
ORDER = ("observations", "object_aliases", "versions", "facts", "edges", "changes", "filter_decisions", "ingestion_offsets")


def write_batch(tables: Mapping[str, DataFrame], root: str, batch: str = "") -> list[str]:
    """Appends each table as Parquet by month; with a batch name, a rerun of that batch overwrites what it wrote before."""
    written = []
    for name in ORDER:
        if name not in tables:
            continue
        df = tables[name]
        if when := PARTITIONED.get(name):
            df = df.withColumn("month", F.date_format(when, "yyyy-MM"))
        writer = df.write.mode("overwrite" if batch else "append")
        (writer.partitionBy("month") if when else writer).parquet(f"{root}/{name}/batch={batch}" if batch else f"{root}/{name}")
        written.append(name)
    return written


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a folder: of one with manifests what they name, else all of its files."""
    if (store := Store(spark, root)).manifests():
        return store.read(name)
    columns = [c.strip().split()[0] for c in TABLES[name].split(",")]
    return spark.read.parquet(f"{root}/{name}").select(*columns)


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """K6: tables by DDL, partitioned by month, with a Parquet bloom filter on the object id."""
    for name, columns in TABLES.items():
        parts = ", month string" if name in PARTITIONED else ""
        by = "PARTITIONED BY (month)" if name in PARTITIONED else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}{parts}) USING parquet {by} OPTIONS ('parquet.bloom.filter.enabled#object_id' 'true')")


def coalesced_offsets(offsets: DataFrame) -> DataFrame:
    """K5: of a batch's offset rows the last of each stream and event; of one time, the version of most digits, then the larger text."""
    w = Window.partitionBy("cluster_id", "api_group", "resource", "namespace", "event").orderBy(F.desc("updated_at"), F.desc(F.length("resource_version")), F.desc("resource_version"))
    return offsets.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def to_tsv(df: DataFrame, most: int = 1000) -> str:
    """K8: a bounded result as tab-separated text."""
    rows = df.limit(most).collect()
    clean = lambda v: "" if v is None else str(v).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")
    return "\n".join(["\t".join(df.columns), *("\t".join(map(clean, r)) for r in rows)])


def to_text(df: DataFrame, most: int = 20, width: int = 120) -> str:
    """A bounded result as compact lines of name=value, empty values left out."""
    return "\n".join(" ".join(f"{k}={v}" for k, v in r.asDict().items() if v not in (None, "", []))[:width] for r in df.limit(most).collect())

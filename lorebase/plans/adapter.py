"""The driver's tables as evidence tables, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import Tables
from ..sources.shared import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    kind = F.when(F.col("event_type") == "signup", "ADDED").when(F.col("event_type") == "error", "DELETED").otherwise("MODIFIED")
    return e.select(F.lit("c1").alias("cluster_id"), F.concat(F.lit("c1/"), user).alias("object_id"), F.col("ts").alias("observed_at"), kind.alias("observation_type"), F.lit("").alias("api_group"), F.lit("v1").alias("api_version"), F.lit("users").alias("resource"), F.lit("User").alias("kind"), F.lit("").alias("namespace"), user.alias("name"), user.alias("uid"), F.col("event_id").cast("string").alias("resource_version"), F.sha2("props", 256).alias("doc_hash"), F.col("props").alias("doc"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", 90).when(F.col("event_type") == "purchase", 50).otherwise(20)
    return e.select(F.lit("c1").alias("cluster_id"), F.col("ts"), F.concat(F.lit("c1/"), F.col("user_id").cast("string")).alias("object_id"), F.lit("User").alias("kind"), F.lit("").alias("namespace"), F.col("user_id").cast("string").alias("name"), F.concat(F.lit("event."), "event_type").alias("fact_key"), F.get_json_object("props", "$.k").alias("fact_value"), F.col("value").alias("numeric_value"), severity.alias("severity"), F.lit("").alias("detail"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = dealt(e.select("user_id", "ts", "event_id", "event_type"), e.count(), "user_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    severity = F.when(F.col("event_type") == "error", 90).otherwise(20)
    c = e.withColumn("old", F.coalesce(F.lag("event_type").over(w), F.lit(""))).where(F.col("old") != F.col("event_type"))
    return c.select(F.lit("c1").alias("cluster_id"), "ts", F.concat(F.lit("c1/"), F.col("user_id").cast("string")).alias("object_id"), F.lit("User").alias("kind"), F.lit("").alias("namespace"), F.col("user_id").cast("string").alias("name"), F.lit("status").alias("change_family"), F.lit("event_type").alias("path"), F.lit("replace").alias("op"), F.col("old").alias("old_scalar"), F.col("event_type").alias("new_scalar"), severity.alias("severity"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    ident = lambda k, c: F.concat(F.lit(f"{k}/"), F.col(c).cast("string"))

    def rows(df: DataFrame, kind: str, src: str, src_col: str, dst: str, dst_col: str, start: str | None, end: str | None) -> DataFrame:
        at = lambda c: F.col(c) if c else F.lit(None).cast("timestamp_ntz")
        begin = at(start) if start else F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")
        return df.select(F.lit("c1").alias("cluster_id"), F.lit(kind).alias("edge_type"), ident(src, src_col).alias("src_id"), ident(dst, dst_col).alias("dst_id"), F.lit(src).alias("src_kind"), F.lit(dst).alias("dst_kind"), begin.alias("valid_from"), at(end).alias("valid_to"), F.lit("").alias("detail"))

    rows_of_lines = t("lineitem").count()  # of the files' footers
    lines = dealt(t("lineitem"), rows_of_lines, "l_orderkey").join(dealt(t("orders").select("o_orderkey", "o_orderdate"), rows_of_lines, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        rows(lines, "order_part", "order", "l_orderkey", "part", "l_partkey", "o_orderdate", "l_shipdate")
        .union(rows(lines, "order_supplier", "order", "l_orderkey", "supplier", "l_suppkey", "o_orderdate", "l_shipdate"))
        .union(rows(t("orders"), "customer_order", "customer", "o_custkey", "order", "o_orderkey", "o_orderdate", None))
        .union(rows(t("customer"), "customer_nation", "customer", "c_custkey", "nation", "c_nationkey", None, None))
        .union(rows(t("nation"), "nation_region", "nation", "n_nationkey", "region", "n_regionkey", None, None))
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return {"observations": observations(spark, sf_dir), "facts": facts(spark, sf_dir), "changes": changes(spark, sf_dir), "edges": edges(spark, sf_dir)}


#: The same views as common table expressions.
SQL = {
    "obs": """obs AS (SELECT 'c1' AS cluster_id, 'c1/' || user_id AS object_id, ts AS observed_at,
  CASE event_type WHEN 'signup' THEN 'ADDED' WHEN 'error' THEN 'DELETED' ELSE 'MODIFIED' END AS observation_type,
  'User' AS kind, '' AS namespace, CAST(user_id AS VARCHAR) AS name, CAST(user_id AS VARCHAR) AS uid,
  CAST(event_id AS VARCHAR) AS resource_version, sha256(props) AS doc_hash, props AS doc FROM events)""",
    "facts": """facts AS (SELECT 'c1' AS cluster_id, ts, 'c1/' || user_id AS object_id, 'event.' || event_type AS fact_key,
  json_extract_string(props, '$.k') AS fact_value, value AS numeric_value,
  CASE event_type WHEN 'error' THEN 90 WHEN 'purchase' THEN 50 ELSE 20 END AS severity FROM events)""",
    "changes": """changes AS (SELECT 'c1' AS cluster_id, ts, 'c1/' || user_id AS object_id, 'status' AS change_family, 'event_type' AS path, 'replace' AS op, old AS old_scalar,
  event_type AS new_scalar, CASE event_type WHEN 'error' THEN 90 ELSE 20 END AS severity
  FROM (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS old FROM events) WHERE old <> event_type)""",
    "edges": """edges AS (
  SELECT 'order_part' AS edge_type, 'order/' || l_orderkey AS src_id, 'part/' || l_partkey AS dst_id, 'order' AS src_kind, 'part' AS dst_kind, o_orderdate AS valid_from, l_shipdate AS valid_to FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'order_supplier', 'order/' || l_orderkey, 'supplier/' || l_suppkey, 'order', 'supplier', o_orderdate, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'customer_order', 'customer/' || o_custkey, 'order/' || o_orderkey, 'customer', 'order', o_orderdate, NULL FROM orders
  UNION ALL SELECT 'customer_nation', 'customer/' || c_custkey, 'nation/' || c_nationkey, 'customer', 'nation', TIMESTAMP '1990-01-01', NULL FROM customer
  UNION ALL SELECT 'nation_region', 'nation/' || n_nationkey, 'region/' || n_regionkey, 'nation', 'region', TIMESTAMP '1990-01-01', NULL FROM nation)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)

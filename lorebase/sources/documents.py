"""Reading JSON documents as observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .resolver import Resolver

EVENT_TYPES = ("ADDED", "MODIFIED", "DELETED", "BOOKMARK")


def event_type(t: Column) -> Column:
    """Upper case; what isn't known is MODIFIED."""
    return F.when(F.upper(t).isin(*EVENT_TYPES), F.upper(t)).otherwise("MODIFIED")


def decode(raw: DataFrame, column: str = "value") -> DataFrame:
    """(observation_type, doc, other columns of raw) of each document: lists item by item, {type, object} wrappers unwrapped. An item that is no object is an error."""
    others = [c for c in raw.columns if c != column]
    kind = F.schema_of_variant
    v = raw.select(*others, F.parse_json(column).alias("v"))
    listed = F.try_variant_get("v", "$.items", "array<variant>")
    items = v.select(*others, F.explode(F.coalesce(listed, F.array("v"))).alias("item"))
    is_object = kind("item").startswith("OBJECT")
    wrapped = F.try_variant_get("item", "$.object", "variant").isNotNull() & F.try_variant_get("item", "$.type", "string").isNotNull()
    doc = F.when(wrapped, F.try_variant_get("item", "$.object", "variant")).otherwise(F.col("item"))
    checked = F.when(is_object, F.to_json(doc)).otherwise(F.raise_error(F.lit("a list item is not an object")).cast("string"))
    return items.select(*others, event_type(F.when(wrapped, F.try_variant_get("item", "$.type", "string"))).alias("observation_type"), checked.alias("doc"))


def read_documents(spark: SparkSession, path: str, cluster_part: int | None = None, per_file: int | None = None) -> DataFrame:
    """All JSON files below a folder. cluster_part counts path parts from the file (1: its folder) that name the cluster; per_file keeps the first items of each list."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("file"))
    rows = decode(raw)
    if cluster_part is not None:
        rows = rows.withColumn("cluster_id", F.element_at(F.split("file", "/"), -1 - cluster_part))
    if per_file is not None:
        from pyspark.sql import Window

        rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("file").orderBy("doc"))).where(F.col("_i") <= per_file).drop("_i")
    return rows


def observations(decoded: DataFrame, resolver: Resolver | None = None, observed_at: Column | None = None, cluster_id: str = "") -> DataFrame:
    """Observation rows of decoded documents: reference columns from the document, resource from the resolver's table."""
    resolver = resolver or Resolver()
    spark = decoded.sparkSession
    known = spark.createDataFrame([(r.group, r.kind, r.resource) for r in resolver.known.values()], "_g string, _k string, resource string")
    at = lambda path: F.coalesce(F.get_json_object("doc", f"$.{path}"), F.lit(""))
    api = at("apiVersion")
    d = decoded.withColumns({
        "api_group": F.when(api.contains("/"), F.split_part(api, F.lit("/"), F.lit(1))).otherwise(""), "api_version": F.element_at(F.split(api, "/"), -1), "kind": at("kind"),
        "namespace": at("metadata.namespace"), "name": at("metadata.name"), "uid": at("metadata.uid"), "resource_version": at("metadata.resourceVersion"), "partial": F.lit(False),
    })
    d = d.withColumn("observed_at", observed_at if observed_at is not None else F.current_timestamp() if "observed_at" not in d.columns else F.col("observed_at"))
    if "cluster_id" not in d.columns:
        d = d.withColumn("cluster_id", F.lit(cluster_id))
    # few rows, of a fixed number: the resource table
    d = d.join(F.broadcast(known), (F.col("api_group") == F.col("_g")) & (F.col("kind") == F.col("_k")), "left").drop("_g", "_k")
    by_rule = F.lower("kind")
    rule = F.when(by_rule.rlike("[^aeiou]y$"), F.regexp_replace(by_rule, "y$", "ies")).when(by_rule.rlike("(s|x|ch|sh)$"), F.concat(by_rule, F.lit("es"))).otherwise(F.concat(by_rule, F.lit("s")))
    return d.withColumn("resource", F.coalesce("resource", rule))


def split_bookmarks(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is stored, bookmarks, which only move offsets)."""
    return decoded.where("observation_type <> 'BOOKMARK'"), decoded.where("observation_type = 'BOOKMARK'")

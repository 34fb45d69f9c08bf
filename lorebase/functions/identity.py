"""Identity rules as column expressions: logical, path and human ids, aliases, document hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(*parts: Column) -> Column:
    """Parts joined by '/', leaving empty ones out."""
    return F.concat_ws("/", *(F.when(p != "", p) for p in parts))


def path_id() -> Column:
    """cluster/[group/]resource/[namespace/]name; '' where cluster, resource or name is missing."""
    c = F.col
    whole = _joined(c("cluster_id"), c("api_group"), c("resource"), c("namespace"), c("name"))
    return F.when((c("cluster_id") != "") & (c("resource") != "") & (c("name") != ""), whole).otherwise("")


def logical_id() -> Column:
    """cluster/uid where there is a uid, else the path form."""
    c = F.col
    return F.when(c("uid") != "", F.concat_ws("/", "cluster_id", "uid")).otherwise(_joined(c("cluster_id"), c("api_group"), c("resource"), c("namespace"), c("name")))


def human_id() -> Column:
    """group/resource/[namespace/]name; begins with a slash for the core group."""
    c = F.col
    return F.concat(c("api_group"), F.lit("/"), c("resource"), F.lit("/"), F.when(c("namespace") != "", F.concat(c("namespace"), F.lit("/"))).otherwise(""), c("name"))


def aliases() -> Column:
    """Distinct, non-empty ids that an observation is known by."""
    human = F.when(F.col("uid") == "", human_id()).otherwise("")
    return F.array_remove(F.array_distinct(F.array(logical_id(), path_id(), human)), "")


def stream_identity() -> Column:
    return F.when(F.col("uid") != "", F.concat(F.lit("uid:"), F.col("uid"))).otherwise(F.concat(F.lit("name:"), F.col("namespace"), F.lit("/"), F.col("name")))


def canonical_json(doc: Column) -> Column:
    """Keys sorted at all depths; a document that can't be parsed stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(doc)), doc)


def doc_hash(doc: Column) -> Column:
    return F.sha2(canonical_json(doc), 256)

"""Connected components by repeated contraction, on edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of each node in edges (a, b): label is one of the nodes of its component, the same for all. Nulls aren't allowed.

    A round moves each node to the least node around it and then moves the edges along; edges within a node fall away, so what is
    left shrinks by half or more a round (a star is gone after one). Each round is written, so it cuts lineage.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    labels = None
    while True:
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = materialize(ends.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to")), name)
        left, right = (move.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        fewer = materialize(edges.join(left, "a").join(right, "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), f"{name}-edges")
        drop_table(edges)
        edges = fewer
        if labels is None:
            labels = move.withColumnRenamed("to", "label")
        else:
            moved = move.select(F.col("node").alias("n"), "to")
            after = materialize(labels.join(moved, F.col("label") == F.col("n"), "left").select("node", F.coalesce("to", "label").alias("label")), name)
            drop_table(labels)
            drop_table(move)
            labels = after
        if not edges.limit(1).count():
            drop_table(edges)
            return labels

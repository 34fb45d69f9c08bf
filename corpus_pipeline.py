"""The corpus pipeline over the documents table: quality rules, line dedup, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; run() writes each result to the
shared folder, reads it back, and removes the stage's own intermediate tables. Stages hold nothing between calls: they can be composed without writing,
and several runs can go on at once. All stages but the last return the columns of documents. No stage can be told in SQL as a whole
(near-duplicate classes and packing are iterative), so ORACLE_SQL is None and tests/llm holds the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.common import documents, drop_paths, materialize, recorded
from lorebase.llm.line_dedup import dedup_lines
from lorebase.llm.mixing import mix
from lorebase.llm.near_dedup import keep_one
from lorebase.llm.packing import pack_documents
from lorebase.llm.quality_rules import filter_documents

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come again; one that loses all its lines goes."""
    return dedup_lines(docs).where((F.col("n_lines_removed") < F.col("n_lines_before")) | (F.col("n_lines_before") <= 0)).drop("n_lines_before", "n_lines_removed")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time it does."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents and their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with recorded() as tables:
            lazy = stage(spark, docs, sf_dir)
        docs = materialize(lazy, name.replace(" ", "_"))
        drop_paths(spark, tables)
    return docs

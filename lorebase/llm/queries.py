"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import documents
from .filter_audit import filter_audit
from .html_text import extract_pages
from .lexical_search import ranked_search
from .line_dedup import line_dedup_report
from .mixing import mix_report
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality_crf import quality_scores
from .quality_rules import quality_report
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .token_output import token_file_digest
from .vector_topk import exact_top_k


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), width=35).drop("kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir)).drop("char_distance", "word_distance")


def op5_quality_rules_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_quality_rules with word limits that follow length as well."""
    return quality_report(documents(spark, sf_dir), by_length=True).drop("char_distance", "word_distance")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_files": op4_token_files,
    "op5_quality_rules": op5_quality_rules,
    "op5_quality_rules_by_length": op5_quality_rules_by_length,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_exact_topk": op9_exact_topk,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_filter_audit": op11_filter_audit,
    "op12_html_extraction": op12_html_extraction,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op5_quality_rules": oracles.QUALITY_RULES,
    "op6_mixing": oracles.MIXING,
    "op7_line_dedup": oracles.LINE_DEDUP,
    "op10_near_duplicates": oracles.NEAR_DUPLICATES,
    "op11_filter_audit": oracles.FILTER_AUDIT,
    "op13_lexical_search": oracles.LEXICAL_SEARCH,
    "op9_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_dot_product(CAST(q.c AS DOUBLE[]), CAST(v.c AS DOUBLE[])) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.c) = len(v.c) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}

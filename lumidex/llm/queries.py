"""The opN_<name> queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, ngram_join, quality_lm, quality_rules, sentencepiece_scan, source_mix, substring_dedup, token_store, topk_search, url_filter
from ._shared import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Vocabulary files are read from the installed tokenizer package, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(table(spark, sf_dir, "documents"), quality_lm.trusted_ids(table(spark, sf_dir, "labels")))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digest_rows(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.digest_rows(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), degrees=True)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality_lm, op2_token_store, op3_language_id, op4_url_filter, op5_sentencepiece, op6_topk_search, op7_quality_rules, op8_substring_dedup, op9_source_mix, op10_ngram_join)}
#: Where SQL can express the whole result.
ORACLE: dict[str, str] = {
    "op4_url_filter": url_filter.ORACLE,
    "op6_topk_search": topk_search.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
}

"""Corpus pipeline: quality rules, near duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.  Part of the subpackage ``lumidex.llm``.

Null texts fail the quality rules.  A text that loses all its words as repeated
passages stays, empty.  A document that the mix takes twice is two rows from
there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.llm import ngram_join, quality_rules, sentencepiece_scan, source_mix, substring_dedup
from lumidex.llm._shared import forget, isolate, pick, table, written
from lumidex.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out, (text, n_chars), back = isolate(substring_dedup.strip(docs), "text", "n_chars")
    return back(out.withColumn(n_chars, F.length(text).cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.resample(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = pick(docs, "doc_id", "lang", "source", "text")
    out = sentencepiece_scan.encode(docs, tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", token_ids),
]

#: Robust estimates, MinHash, balanced sampling and tokenizers are not SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        new = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            new = written(new, "stage")
            forget(docs)
        docs = new
    return docs

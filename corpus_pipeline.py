"""Corpus pipeline over ``documents``: quality, near duplicates, repeated passages, benchmark leaks, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shotloom.llm import decontamination, ngram_jaccard_join, quality_classifier, sentencepiece_codec, substring_dedup
from shotloom.llm._graph import durable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows outside the held-out fold, scores 0.3 or more.

    Null and empty texts are scored as empty ones; repeated rows are judged alike; extra columns stay; an empty table stays empty.
    """
    machine = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, machine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked at Jaccard 0.75 over 5-word shingles.

    Null and empty texts link with nothing and stay, as do rows without an id; of rows with one id the least stays; extra columns stay; an empty table stays empty.
    """
    return ngram_jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document with a smaller id has.

    Null and empty texts and rows without an id stay as they are; a text that is all repeated becomes empty; extra columns stay; an empty table stays empty.
    """
    return substring_dedup.cut_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window is near to a benchmark item.

    Null and empty texts stay; repeated rows are judged alike; extra columns stay; an empty table on either side takes nothing away.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and same_text of each document; null and empty texts have no ids, repeated rows come back as often, an empty table gives no rows."""
    return sentencepiece_codec.token_report(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminated),
    ("sentencepiece", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage gives is written to the checkpoint folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

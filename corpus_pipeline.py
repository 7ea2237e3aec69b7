"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, source mix, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionflow.llm import common, line_dedup, ngram_join, sentencepiece_fst, source_mix, toxicity_crf


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the CRF calls toxic go."""
    return toxicity_crf.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text."""
    out = line_dedup.dedup_lines(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_one(spark, docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.mixed(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of each document."""
    return sentencepiece_fst.encode(spark, docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mix", source_weights),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    base = common.workdir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = common.saved(stage(spark, docs, sf_dir), f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The CRF and the mix have no SQL form; tests hold the pipeline against its own stages only.
ORACLE_SQL = None

"""The queries of this subpackage and their SQL, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionflow.llm import embedding_forest, exact_dedup, html_crf, license_diagonal, line_dedup, ngram_join, oracles, sentencepiece_fst, source_mix, threshold_search, token_files, toxicity_crf, warc_index


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(spark, _read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(spark, _read(spark, sf_dir, "pages"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.archive(spark, _read(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_crf.score(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_diagonal.scan(spark, _read(spark, sf_dir, "documents"))[0]


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(spark, _read(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark, _read(spark, sf_dir, "documents"))[0]


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spark, _read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.near_dedup(spark, _read(spark, sf_dir, "embeddings"))[0]


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark, f"{sf_dir}/documents.parquet")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.search(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded(spark, _read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_html_extraction": op2_html_extraction,
        "op3_warc_index": op3_warc_index,
        "op4_toxicity": op4_toxicity,
        "op5_license_scans": op5_license_scans,
        "op6_source_mix": op6_source_mix,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_line_dedup": op8_line_dedup,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_lexical_search": op11_lexical_search,
        "op12_token_index": op12_token_index,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)

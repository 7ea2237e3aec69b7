"""Words of each source in the mix against its target."""

import random

from pyspark.sql import functions as F

from ionflow.llm import source_mix


def test_whole_documents_meet_targets(spark):
    """Sources with weights 1, 2, 3 and documents of very unlike lengths: off by less than a document."""
    rng = random.Random(4)
    data = [(k, " ".join(["w"] * rng.choice([5, 40, 300, 900])), f"s{k % 3}") for k in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    target = {r.source: r.target for r in source_mix.mix(spark, docs).join(docs, "doc_id").groupBy("source").agg(F.max("target").alias("target")).collect()}
    words = {r.source: r.words for r in source_mix.mixed(spark, docs).groupBy("source").agg(F.sum(source_mix.size_of(F.col("text"))).alias("words")).collect()}
    assert all(abs(words.get(s, 0) - t) <= 900 + source_mix.BLOCK_WORDS for s, t in target.items())


def test_shards_of_large_sources(spark, monkeypatch):
    """With many shards every row has its part once, and sources still meet their targets."""
    monkeypatch.setattr(source_mix, "SHARD_WORDS", 500)
    docs = spark.range(900).selectExpr("id as doc_id", "repeat('w ', cast(5 + id % 40 as int)) as text", "concat('s', id % 3) as source")
    rows = source_mix.mix(spark, docs).join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert [r.n for r in rows] == [300] * 3
    assert all(abs(r.taken - r.target) <= 2 * source_mix.BLOCK_WORDS for r in rows)


def test_small_targets_are_met(spark):
    docs = spark.range(60).selectExpr("id as doc_id", "repeat('w ', cast(if(id < 6, 2, 40) as int)) as text", "concat('s', if(id < 6, id % 3, 3 + id % 3)) as source")
    got = source_mix.mix(spark, docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 6 and all(abs(r.taken - r.target) <= max(1, 0.03 * r.target) for r in got)

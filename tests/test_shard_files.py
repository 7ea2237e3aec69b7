"""Shards lie in as many files as tasks, however many they are, and each is whole in one."""

import os

from pyspark.sql import functions as F

from ionflow.sources import files


def test_many_shards_are_few_files(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id % 1000 as k", "id")
    files.write_shards(rows, f"{tmp_path}/s", "k", 5)
    shards = spark.read.parquet(f"{tmp_path}/s")
    assert shards.count() == 3000 and dict(shards.dtypes)["shard"] == "int"
    assert [r.shard for r in shards.groupBy("shard").agg(F.count_distinct("k").alias("n")).where("n = 5").orderBy("shard").collect()] == list(range(200))
    assert shards.select("shard", F.input_file_name().alias("file")).distinct().count() == 200
    assert not any(os.path.isdir(f"{tmp_path}/s/{n}") for n in os.listdir(f"{tmp_path}/s"))
    assert len(shards.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_faults_of_null_keys(spark):
    shards = spark.sql("select * from values (1, 0), (2, 0), (null, 1), (null, 2) as t(k, shard)")
    expected = spark.sql("select * from values (1), (3), (null) as t(k)")
    assert files.shard_faults(shards, expected, "k") == {"missing": 2, "unknown": 2, "in_several": 1, "out_of_order": 0, "other_size": 0}

"""Spectra are judged without a shuffle of their peaks by structure, where conflicts are few."""

import os
import re

import pytest
from pyspark.sql import functions as F

from ionflow.config import EngineConfig
from ionflow.operators import quality
from ionflow.plans import derived

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_conflicts_are_joined_by_their_size(spark, tmp_path):
    derived.spectra(spark, DATA).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "10000")  # the spectra lie above, conflicts and labels below
    try:
        x = quality.judged(raw, EngineConfig())
        plan = x._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [inchikey14" in plan and not re.search(r"SortMergeJoin \[inchikey14", plan)
        few = x.groupBy("reason").count().collect()
        spark.conf.set(name, "-1")
        # the same where conflicts do not fit
        x = quality.judged(raw, EngineConfig())
        assert re.search(r"SortMergeJoin \[inchikey14", x._jdf.queryExecution().sparkPlan().toString())
        assert sorted(map(tuple, few), key=str) == sorted(map(tuple, x.groupBy("reason").count().collect()), key=str)
        assert x.where(F.col("reason") == "conflicting_structure").count() > 0
    finally:
        spark.conf.set(name, old)

"""A table of results that is computed unit by unit and taken up again where it was left.

A cache lies under root in a folder named by a digest of all that its rows
depend on, so that other data, settings or limits never find it. Units of work
(buckets of a prepared data set) are computed some at a time; their rows are
written by dynamic partition overwrite, a partition a unit, and only then does
the log say so. What a run that was killed has left without a line in the log is
computed again and overwritten; what the log has is not.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_LOG = "unit int, rows long"


def digest(identity: dict) -> str:
    """Of JSON with sorted keys, so that the order of settings has no part in it."""
    return hashlib.sha256(json.dumps(identity, sort_keys=True, allow_nan=False).encode()).hexdigest()


class UnitCache:
    """Rows by unit; unit is an int column of what is computed from and of what is stored."""

    def __init__(self, spark: SparkSession, root: str, identity: dict):
        self.spark, self.identity = spark, identity
        self.path = f"{root.rstrip('/')}/{digest(identity)[:32]}"

    def log(self) -> DataFrame:
        """(unit, rows) of the units that are done."""
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.path}/log").distinct()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LOG)

    def pending(self, rows: DataFrame, unit: str) -> DataFrame:
        """Units of rows that are not done."""
        return rows.select(F.col(unit).cast("int").alias("unit")).distinct().join(self.log(), "unit", "left_anti")

    def fill(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], unit: str = "bucket", at_once: int = 8, told: Callable[[int, int], None] | None = None) -> DataFrame:
        """compute of the rows of all pending units; the whole cache.

        compute keeps the unit column, and needs no rows of other units. told is
        called after each step with how many units are done and how many there are.
        """
        left = sorted(r.unit for r in self.pending(rows, unit).collect())  # as many as there are buckets
        schema = None
        for k in range(0, len(left), at_once):
            some = left[k : k + at_once]
            made = compute(rows.where(F.col(unit).isin(some)))
            made = made.withColumn("unit", F.col(unit).cast("int"))
            schema = made.schema
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit").parquet(f"{self.path}/rows")
            names = self.spark.createDataFrame([(u,) for u in some], "unit int")
            counts = self._rows(schema).where(F.col("unit").isin(some)).groupBy("unit").agg(F.count("*").alias("rows"))
            done = names.join(counts, "unit", "left").select("unit", F.coalesce("rows", F.lit(0)).alias("rows"))
            done.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
            if told:
                told(min(k + at_once, len(left)), len(left))
        if schema is None:  # nothing was left to do
            try:
                schema = self.spark.read.parquet(f"{self.path}/rows").schema
            except AnalysisException:  # no unit has rows
                schema = compute(rows.limit(0)).withColumn("unit", F.lit(0)).schema
        return self._rows(schema).join(self.log().select("unit"), "unit", "left_semi").drop("unit")

    def _rows(self, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

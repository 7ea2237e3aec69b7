"""Batch job: a raw spectral library to training data, with what was turned down and why.

python -m jobs.prepare_library --tables TABLES --output OUT [--config FILE]

Reads the library, here derived from the tables orders and lineitem, and judges
each spectrum by the rejection cascade. Accepted spectra go to OUT/accepted by
split and bucket of their structure, so that a structure is in one split and one
bucket; the others go to OUT/rejected by reason, with their peaks, to be looked
into; OUT/report has, by source and reason, how many there are and the median
and 99th percentile of the given mass errors, exact whatever a source's size.

All three are overwritten as wholes from the same input, so that a run again
gives the same result. Nulls and broken values are reasons of rejection, not
errors; repeated rows are judged one by one.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionflow.config import EngineConfig
from ionflow.functions import hashing as H
from ionflow.operators import quality, quantiles
from ionflow.plans import derived
from ionflow.sources.tables import materialize
from jobs import common

#: seed: of the split; buckets: of a split; file_rows: rows of a file aimed at.
DEFAULTS = {"seed": 42, "buckets": 32, "file_rows": 1_000_000}


def judged(raw: DataFrame, settings: dict) -> DataFrame:
    """Columns of a library with source, formula, split, bucket and reason (null: accepted)."""
    x = quality.judged(raw, EngineConfig(seed=settings["seed"]))
    return x.withColumn("bucket", F.when(F.col("reason").isNull(), H.bucket_for(F.col("inchikey14"), settings["buckets"])))


def report(x: DataFrame) -> DataFrame:
    """Per source and reason: spectra, and exact quantiles of the absolute mass errors given (null where none is)."""
    rows = x.select("source", F.coalesce("reason", F.lit("accepted")).alias("reason"), F.abs("precursor_error_ppm").alias("error"))
    by = rows.groupBy("source", "reason").agg(F.count("*").alias("spectra"))
    q = quantiles.nearest(rows, ["source", "reason"], "error", {"error_median": 0.5, "error_p99": 0.99})
    return by.join(q, ["source", "reason"], "left")  # neither is null


def run(spark: SparkSession, tables: str, output: str, settings: dict = DEFAULTS) -> DataFrame:
    """Judge the library and write accepted, rejected and report; all spectra as they were written."""
    raw, read = common.counted(derived.spectra(spark, tables), "spectra")
    # judged once: three outputs are made of it
    x = materialize(judged(raw, settings).drop("vector", "shift", "delta", "charge"), "judged")
    common.log.info("read %d spectra of %s", read(), tables)
    good, accepted = common.counted(x.where("reason is null").drop("reason"), "accepted")
    bad, rejected = common.counted(x.where("reason is not null").drop("split", "bucket"), "rejected")
    # partitions that are large are dealt to several tasks
    good = good.hint("rebalance", "split", "bucket").sortWithinPartitions("split", "bucket", "inchikey14", "row_ord")
    good.write.mode("overwrite").partitionBy("split", "bucket").option("compression", "zstd").option("maxRecordsPerFile", settings["file_rows"]).parquet(f"{output}/accepted")
    bad.hint("rebalance", "reason").write.mode("overwrite").partitionBy("reason").option("compression", "zstd").option("maxRecordsPerFile", settings["file_rows"]).parquet(f"{output}/rejected")
    table, lines = common.counted(report(x), "report")
    table.repartition(1).write.mode("overwrite").parquet(f"{output}/report")
    common.log.info("wrote %d accepted and %d rejected spectra and %d lines of report to %s", accepted(), rejected(), lines(), output)
    return spectra(spark, output, x)


def spectra(spark: SparkSession, output: str, like: DataFrame) -> DataFrame:
    """Both outputs read back: row_ord, source, formula, peaks, split, bucket, reason."""
    kinds = {f.name: f.dataType.simpleString() for f in like.schema.fields}

    def read(name: str, columns: list[str]) -> DataFrame:
        shape = ", ".join(f"`{c}` {kinds[c]}" for c in [*own, *columns])
        return spark.read.schema(shape).parquet(f"{output}/{name}")

    own = ["row_ord", "source", "formula", "ms2_mzs"]
    both = read("accepted", ["split", "bucket"]).unionByName(read("rejected", ["reason"]), allowMissingColumns=True)
    return both.select("row_ord", "source", "formula", F.size("ms2_mzs").alias("peaks"), "split", "bucket", "reason")


if __name__ == "__main__":
    sys.exit(common.main("prepare_library", ["tables", "output"], DEFAULTS, run))

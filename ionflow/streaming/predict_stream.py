"""Prediction over a folder that spectra files arrive in: one micro-batch has whole molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionflow.engine import FormulaEngine


def predict_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, engine: FormulaEngine | None = None, top_k: int = 25, files_per_batch: int = 1) -> None:
    """Predict all files not seen yet, a batch a file, and stop. Molecules must be complete within a batch.

    Each batch overwrites its own folder, so that a batch run again after a
    failure leaves its results once.
    """
    engine = engine or FormulaEngine(spark)
    schema = spark.read.parquet(folder).schema

    def one(batch: DataFrame, k: int) -> None:
        engine.predict(batch, top_k).write.mode("overwrite").parquet(f"{output}/batch={k}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    rows = rows.select("*", F.col("_metadata.row_index").alias("row_ord"))
    rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

"""Incremental job: molecular formulas that texts mention, for lists of known formulas.

python -m jobs.formula_mentions --documents DOCS --output OUT --checkpoint CP [--config FILE]

Whether a predicted formula is known already is asked in every evaluation; this
job keeps the list of formulas in literature. A file stream takes the document
files that the checkpoint has not seen, and appends their mentions to
OUT/mentions, by language. Then OUT/formulas is made from all mentions: one row
a formula with its mass, documents and mentions, partitioned by mass range. It is
written in full, so that a run again after a failure at any place, or one
without new files, leaves the same tables.

A mention is a whole run of ASCII letters and digits that is a formula of at
least least_elements different elements; counts of more than five digits are
none. A document is known by its doc_id: rows that repeat it, in one file or
several, add mentions, but no document. A null text has none; rows without
doc_id count no document. Other columns are ignored.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionflow.constants import ELEMENTS
from ionflow.functions import chemistry as C
from ionflow.operators import evaluate, quality
from jobs import common

#: least_elements: different elements of a formula; files_per_batch: of the stream.
DEFAULTS = {"least_elements": 2, "files_per_batch": 1000}
#: Tokens that may be formulas: symbols of the ten elements, each with a count or none.
_FORMULA = "^(?:(?:" + "|".join(sorted(ELEMENTS, key=len, reverse=True)) + ")(?:[1-9][0-9]{0,4})?)+$"


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, token): a row each time a token that may be a formula stands in a text."""
    tokens = F.regexp_extract_all(F.col("text").cast("string"), F.lit("[A-Za-z0-9]+"), F.lit(0))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.explode(tokens).alias("token"))
    return found.where(F.col("token").rlike(_FORMULA))


def formulas(found: DataFrame, least_elements: int) -> DataFrame:
    """One row a formula: mass, dbe, mass_bin, documents, mentions, first_doc_id."""
    # a row a token and document first, so that what is shuffled on is small
    by = found.groupBy("token", "doc_id").agg(F.count("*").alias("n")).withColumnRenamed("token", "molecular_formula")
    labels = quality.parsed_labels(by).where(F.size(F.filter("vector", lambda n: n > 0)) >= least_elements)
    rows = by.join(labels, "molecular_formula")
    # of spellings of one formula a document counts once
    docs = rows.groupBy("formula", "vector", "mass", "doc_id").agg(F.sum("n").alias("n"))
    out = docs.groupBy("formula", "vector", "mass").agg(F.count("doc_id").alias("documents"), F.sum("n").alias("mentions"), F.min("doc_id").alias("first_doc_id"))
    return out.select("formula", "mass", C.dbe(F.col("vector")).cast("double").alias("dbe"), "documents", "mentions", "first_doc_id", evaluate.mass_bin(F.col("mass")).alias("mass_bin"))


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict = DEFAULTS) -> DataFrame:
    """Take new documents into output; the table of formulas as it stands."""
    schema = spark.read.parquet(documents).schema
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(common.stream_path(documents))
    stream = mentions(new).writeStream.format("parquet").partitionBy("lang").option("path", f"{output}/mentions").option("checkpointLocation", checkpoint)
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination()
    common.log.info("read %d new documents of %s", sum(p["numInputRows"] for p in query.recentProgress), documents)
    found = spark.read.schema("doc_id long, token string, lang string").parquet(f"{output}/mentions")
    table, rows = common.counted(formulas(found, settings["least_elements"]), "formulas")
    # few rows a mass range, however many documents: a formula each
    table.repartition("mass_bin").write.mode("overwrite").partitionBy("mass_bin").parquet(f"{output}/formulas")
    common.log.info("wrote %d formulas to %s/formulas", rows(), output)
    return spark.read.schema(table.schema).parquet(f"{output}/formulas")


if __name__ == "__main__":
    sys.exit(common.main("formula_mentions", ["documents", "output", "checkpoint"], DEFAULTS, run))

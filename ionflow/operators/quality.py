"""Audit, conflict quarantine, rejection cascade and the prepared data set of a raw spectral library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ionflow.config import EngineConfig
from ionflow.constants import ELEMENTS
from ionflow.functions import chemistry as C, hashing as H
from ionflow.operators import quantiles, spectra as S
from ionflow.sources import files
from ionflow.sources.tables import materialize

#: Rows of a file of the prepared data aimed at.
FILE_ROWS = 1_000_000

PREPARED = (
    "precursor_mz double, adduct string, ionization_mode string, ms2_mzs array<double>, ms2_normalized_intensities array<double>, "
    "collision_energy_ev array<double>, base_peak_intensity double, instrument_type string, molecule_id string, spectrum_id string, "
    "molecular_formula string, ingest_lib string"
)


def nearest_quantile(x: Column, q: float) -> Column:
    """The value nearest to place q of the sorted values, nulls left out: of groups whose values fit in a row (else quantiles.nearest)."""
    v = F.array_sort(F.collect_list(x))
    return F.try_element_at(v, (F.round((F.size(v) - 1) * F.lit(float(q))) + 1).cast("int"))


def n_unique(x: str) -> Column:
    """Distinct values, null being one."""
    return F.count_distinct(x) + F.coalesce(F.max(F.col(x).isNull().cast("int")), F.lit(0))


def null_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in rows.columns))


def peak_stats(rows: DataFrame) -> DataFrame:
    a, b = F.array_size("ms2_mzs"), F.array_size("ms2_normalized_intensities")
    return rows.agg(F.count_if(a != b).alias("misaligned"), F.count_if(a == 0).alias("empty"), F.median(a).alias("median"), F.max(a).alias("max"))


def source_stats(rows: DataFrame) -> DataFrame:
    """Spectra of each source, median and 99th percentile of the absolute errors given: exact, however large a source is."""
    x = rows.select("ingest_lib", F.abs("precursor_error_ppm").alias("error"))
    out = x.groupBy("ingest_lib").agg(F.count("*").alias("spectra"))
    for q in (quantiles.linear(x, ["ingest_lib"], "error", {"provided_error_median_ppm": 0.5}), quantiles.nearest(x, ["ingest_lib"], "error", {"provided_error_p99_ppm": 0.99})):
        out = out.join(q.withColumnRenamed("ingest_lib", "__lib"), F.col("ingest_lib").eqNullSafe(F.col("__lib")), "left").drop("__lib")
    return out


def parsed_labels(rows: DataFrame) -> DataFrame:
    """(molecular_formula, vector, mass, formula) of each distinct label that parses.

    Written once: parsing is a long expression, which the optimizer would
    otherwise repeat in every place that reads its result.
    """
    x = rows.select("molecular_formula").distinct().withColumn("vector", C.parse_formula(F.col("molecular_formula"))).where("vector is not null")
    x = materialize(x, "labels")
    return materialize(x.withColumn("mass", C.exact_mass(F.col("vector"))).withColumn("formula", C.format_formula(F.col("vector"))), "labels")


def conflicts(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Structures with more than one label: the canonical formula, the raw string where it is none, or null."""
    labels = parsed_labels(rows) if labels is None else labels
    pairs = rows.where("inchikey14 is not null").select("inchikey14", "molecular_formula").distinct()
    label = F.coalesce("formula", "molecular_formula", F.lit("\x00"))
    pairs = pairs.join(labels.select("molecular_formula", "formula"), "molecular_formula", "left")
    return pairs.groupBy("inchikey14").agg(F.count_distinct(label).alias("labels")).where("labels > 1").select("inchikey14")


def audit(rows: DataFrame) -> dict:
    """A report on raw rows: counts, nulls, peaks, formulas, sources."""
    out = {
        "rows": rows.count(),
        "schema": {f.name: f.dataType.simpleString() for f in rows.schema.fields},
        "null_counts": null_counts(rows).first().asDict(),
        "adducts": [r.asDict() for r in rows.groupBy("adduct").count().collect()],
        "peaks": peak_stats(rows).first().asDict(),
    }
    if "molecular_formula" in rows.columns:
        by = rows.groupBy("molecular_formula").count().withColumn("ok", C.parse_formula(F.col("molecular_formula")).isNotNull())
        sums = by.agg(F.count("*").alias("n"), F.sum(F.when(F.col("ok"), F.col("count")).otherwise(0)).alias("supported")).first()
        out |= {
            "unique_formulas": sums["n"],
            "supported_formula_spectra": sums["supported"] or 0,
            "unsupported_formulas": [{"formula": r[0], "spectra": r[1]} for r in by.where("not ok").select("molecular_formula", "count").collect()],
            "conflicting_structures": conflicts(rows).count(),
            "unique_structures": rows.agg(n_unique("inchikey14")).first()[0],
            "sources": [r.asDict() for r in source_stats(rows).collect()],
        }
    if "molecule_id" in rows.columns:
        out["molecules"] = rows.agg(n_unique("molecule_id")).first()[0]
    return out


def judged(rows: DataFrame, config: EngineConfig, bad: DataFrame | None = None) -> DataFrame:
    """rows with source, vector, formula, reason (null: accepted) and split; the first reason that holds."""
    labels = parsed_labels(rows)
    # written first: by its real size Spark broadcasts it where it fits, and the spectra with their peaks are not shuffled by structure
    bad = materialize((conflicts(rows, labels) if bad is None else bad).select(F.col("inchikey14").alias("__bad")).distinct(), "conflicts")
    x = C.with_adduct(rows).join(bad, F.col("inchikey14") == F.col("__bad"), "left")
    x = x.withColumn("source", F.when(F.coalesce("ingest_lib", F.lit("")) == "", "unknown").otherwise(F.col("ingest_lib")))
    x = x.drop("vector", "mass", "formula").join(labels, "molecular_formula", "left")
    expected = C.mz(F.col("mass"), F.col("shift"))
    ion = C.ion_counts(F.col("vector"), F.col("delta"))
    measured = F.col("precursor_mz")
    status, _ = S.problem()
    reason = (
        F.when(F.coalesce("inchikey14", F.lit("")) == "", "missing_structure_id")
        .when(F.col("__bad").isNotNull(), "conflicting_structure")
        .when(F.col("vector").isNull(), "unsupported_formula")
        .when(F.col("charge").isNull(), "unsupported_adduct")
        .when((expected <= 0) | ~C.feasible(ion), "invalid_ion_composition")
        .when(measured.isNull() | F.isnan(measured) | (F.abs(measured) == float("inf")) | (F.abs(C.ppm(measured, expected)) > 20), "precursor_error_gt20ppm")
        .when(status.isNotNull(), "invalid_spectrum")
    )
    x = x.withColumn("reason", reason)
    return x.withColumn("split", F.when(F.col("reason").isNull(), H.split_for(F.col("inchikey14"), config.seed))).drop("__bad", "mass")


def tallies(rows: DataFrame) -> DataFrame:
    """Rows by source and reason ("accepted" where there is none), and by reason over all sources."""
    what = rows.select("source", F.coalesce("reason", F.lit("accepted")).alias("reason"))
    return what.rollup("reason", "source").agg(F.count("*").alias("spectra")).where("reason is not null")


def element_limits(accepted: DataFrame) -> DataFrame:
    """Limits from the train split only: the largest count of each element, and a fifth."""
    most = [F.max(F.when(F.col("split") == "train", F.element_at("vector", k + 1))).alias(e) for k, e in enumerate(ELEMENTS)]
    return accepted.agg(*most).select(*(F.ceil(F.coalesce(e, F.lit(0)) * F.lit(1.2)).cast("int").alias(e) for e in ELEMENTS))


def coverage(accepted: DataFrame, limits: dict) -> DataFrame:
    """Distinct formulas of each split, and how many lie within limits."""
    within = None
    for k, e in enumerate(ELEMENTS):
        ok = F.element_at("vector", k + 1) <= limits[e]
        within = ok if within is None else within & ok
    return accepted.select("split", "formula", "vector").distinct().groupBy("split").agg(F.count("*").alias("unique_formulas"), F.count_if(within).alias("within_element_limits"))


def prepare(spark: SparkSession, path: str, output: str, config: EngineConfig, buckets: int = 32) -> dict:
    """Write accepted spectra by split and bucket, with config, train formulas and manifest beside them."""
    files.require_new_dir(output)
    raw = files.with_row_index(spark, path)
    mark = files.mark(path)
    # judged once: the steps below read the table
    x = materialize(judged(raw, config), "judged")
    good = x.where("reason is null")
    bucket = H.bucket_for(F.col("inchikey14"), buckets)
    out = good.select(
        *S.INFERENCE_COLUMNS, F.col("inchikey14").alias("molecule_id"), F.concat(F.lit(mark + ":"), "row_ord").alias("spectrum_id"),
        F.col("formula").alias("molecular_formula"), F.col("source").alias("ingest_lib"), "row_ord", "split", bucket.alias("bucket"),
    )
    by = tallies(x).collect()
    accepted = sum(r["spectra"] for r in by if r["source"] is None and r["reason"] == "accepted")
    # a bucket is as many files as its rows need, a molecule in one; its rows stand by molecule and input order
    parts = 1 + accepted // (3 * buckets * FILE_ROWS)
    out = out.repartition(3 * buckets * parts, "split", "bucket", F.pmod(F.xxhash64("molecule_id"), F.lit(parts))).sortWithinPartitions("split", "bucket", "molecule_id", "row_ord")
    out.write.partitionBy("split", "bucket").option("compression", "zstd").parquet(f"{output}/spectra")
    limits = element_limits(good).first().asDict()
    total = {r["reason"]: r["spectra"] for r in by if r["source"] is None}
    sources: dict = {}
    for r in by:
        if r["source"] is not None:
            sources.setdefault(r["source"], {})[r["reason"]] = r["spectra"]
    derived = EngineConfig(**{**config.to_dict(), "element_limits": limits})
    total.pop("accepted", None)
    report = {
        "file_fingerprint": mark,
        "input": path,
        "input_rows": accepted + sum(total.values()),
        "accepted_spectra": accepted,
        "accepted_by_split": {r[0]: r[1] for r in good.groupBy("split").count().collect()},
        "rejected": total,
        "by_source": sources,
        "conflicting_structures": conflicts(raw).count(),
        "element_limits": limits,
        "coverage": {r["split"]: {k: r[k] for k in ("unique_formulas", "within_element_limits")} for r in coverage(good, limits).collect()},
        "seed": config.seed,
        "buckets": buckets,
    }
    files.write_json(f"{output}/config.json", derived.to_dict())
    files.write_json(f"{output}/train_formulas.json", [r[0] for r in good.where("split = 'train'").select("formula").distinct().orderBy("formula").collect()])
    files.write_json(f"{output}/manifest.json", report)
    return report

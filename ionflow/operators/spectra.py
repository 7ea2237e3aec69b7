"""Validation, normalisation and dedup of spectra: row-local array expressions, no shuffle but for dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionflow.config import EngineConfig
from ionflow.functions import chemistry as C

#: What inference may see of a row; labels are not among it.
INFERENCE_COLUMNS = ("precursor_mz", "adduct", "ionization_mode", "ms2_mzs", "ms2_normalized_intensities", "collision_energy_ev", "base_peak_intensity", "instrument_type")


def _bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def problem() -> tuple[Column, Column]:
    """(status, message) of a row that has its adduct's columns: the first check that fails, else null."""
    mode = F.when(F.col("charge") > 0, "positive").otherwise("negative")
    mzs, ints, ce, base = (F.col(c) for c in ("ms2_mzs", "ms2_normalized_intensities", "collision_energy_ev", "base_peak_intensity"))
    checks = (
        ("unsupported_input", F.concat(F.lit("Unsupported adduct: "), F.coalesce("adduct", F.lit("None"))), F.col("charge").isNull()),
        ("invalid_input", F.lit("ionization_mode conflicts with adduct"), F.col("ionization_mode").isNotNull() & (F.col("ionization_mode") != mode)),
        ("invalid_input", F.lit("precursor_mz must be positive and finite"), _bad(F.col("precursor_mz")) | (F.col("precursor_mz") <= 0)),
        ("invalid_input", F.lit("Peak arrays must be aligned one-dimensional arrays"), mzs.isNull() | ints.isNull() | (F.array_size(mzs) != F.array_size(ints))),
        ("invalid_input", F.lit("Invalid peak mass or intensity"), F.exists(mzs, lambda x: _bad(x) | (x <= 0)) | F.exists(ints, lambda x: _bad(x) | (x < 0))),
        ("invalid_input", F.lit("collision_energy_ev must be a finite nonnegative list"), ce.isNotNull() & F.exists(ce, lambda x: _bad(x) | (x < 0))),
        ("invalid_input", F.lit("Invalid base_peak_intensity"), base.isNotNull() & (_bad(base) | (base < 0))),
    )
    status, message = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for s, m, broken in checks:
        status, message = status.when(broken, s), message.when(broken, m)
    return status, message


def _once(x: Column, of) -> Column:
    """of(x) with x computed once: the optimizer would repeat it in each place that reads it."""
    return F.transform(F.array(x), of)[0]


def merged_peaks(mzs: Column, ints: Column) -> Column:
    """Peaks by m/z, intensities of equal m/z added up."""
    peaks = F.arrays_zip(mzs.alias("mz"), ints.alias("intensity"))

    def summed(once):
        return F.transform(F.array_sort(once), lambda m: F.struct(m.alias("mz"), F.aggregate(F.filter(peaks, lambda p: p["mz"] == m), F.lit(0.0), lambda a, p: a + p["intensity"]).alias("intensity")))

    return _once(F.array_distinct(mzs), lambda once: F.when(F.size(once) == F.size(mzs), F.array_sort(peaks)).otherwise(summed(once)))


def clean_peaks(peaks: Column, config: EngineConfig) -> Column:
    """Scaled to the base peak, weak ones dropped, the strongest max_peaks kept in order of m/z."""
    none = F.array().cast("array<struct<mz:double,intensity:double>>")

    def best(strong):
        by_power = F.array_sort(F.transform(strong, lambda p: F.struct((-p["intensity"]).alias("i"), p["mz"].alias("mz"))))
        return F.array_sort(F.transform(F.slice(by_power, 1, config.max_peaks), lambda p: F.struct(p["mz"].alias("mz"), (-p["i"]).alias("intensity"))))

    def cleaned(own, top):
        scaled = F.transform(own, lambda p: F.struct(p["mz"].alias("mz"), (p["intensity"] / top).alias("intensity")))
        strong = F.filter(scaled, lambda p: (p["intensity"] >= config.intensity_floor) & (p["intensity"] > 0))
        return F.when(F.coalesce(top, F.lit(0.0)) <= 0, none).otherwise(_once(strong, lambda s: F.when(F.size(s) <= config.max_peaks, s).otherwise(best(s))))

    return _once(peaks, lambda own: _once(F.array_max(F.transform(own, lambda p: p["intensity"])), lambda top: cleaned(own, top)))


def normalize(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """rows with adduct columns, status, message, and peaks and collision energies where there is no problem."""
    status, message = problem()
    out = C.with_adduct(rows).withColumn("status", status).withColumn("message", message)
    good = F.col("status").isNull()
    out = out.withColumn("merged", F.when(good, merged_peaks(F.col("ms2_mzs"), F.col("ms2_normalized_intensities"))))
    out = out.withColumn("peaks", clean_peaks(F.col("merged"), config)).drop("merged")
    ce = F.when(good & (F.size("collision_energy_ev") > 0), F.col("collision_energy_ev"))
    n = F.size(ce)
    return out.withColumns({
        "ce_mean": F.aggregate(ce, F.lit(0.0), lambda a, x: a + x) / n,
        "ce_min": F.array_min(ce),
        "ce_max": F.array_max(ce),
    })


def with_ids(rows: DataFrame, order: str = "row_ord") -> DataFrame:
    """spectrum_id, where null or '', from the place in the molecule, before any is dropped."""
    place = F.row_number().over(W.partitionBy("molecule_id").orderBy(order)) - 1
    return rows.withColumn("spectrum_id", F.when(F.coalesce("spectrum_id", F.lit("")) == "", F.concat(F.lit("spectrum_"), place)).otherwise(F.col("spectrum_id")))


def drop_repeats(rows: DataFrame, order: str = "row_ord") -> DataFrame:
    """Of equal observations of a molecule the first stays; the id is not part of what is compared."""
    key = ["precursor_mz", "adduct", "ms2_mzs", "ms2_normalized_intensities", "collision_energy_ev", "base_peak_intensity", "instrument_type"]
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("molecule_id", *key).orderBy(order))).where("__n = 1").drop("__n")


def clean_by_rule(rows: DataFrame, least_base: float = 1000.0, above: float = 2.0, keep_unknown_base: bool = False, gate: bool = True) -> DataFrame:
    """Rule for aligning sources: spectra with too small a base peak go, peaks beyond precursor + above go.

    keep_unknown_base keeps spectra without a base peak intensity; without gate only peaks go.
    """
    if gate:
        ok = F.col("base_peak_intensity") >= least_base
        rows = rows.where(ok | F.col("base_peak_intensity").isNull() if keep_unknown_base else ok)
    peaks = F.filter(F.arrays_zip(F.col("ms2_mzs").alias("mz"), F.col("ms2_normalized_intensities").alias("intensity")), lambda p: p["mz"] <= F.col("precursor_mz") + above)
    n = F.size("ms2_mzs")
    rows = rows.withColumn("__p", peaks).withColumn("peaks_removed", n - F.size("__p"))
    return rows.withColumn("ms2_mzs", F.transform("__p", lambda p: p["mz"])).withColumn("ms2_normalized_intensities", F.transform("__p", lambda p: p["intensity"])).drop("__p")

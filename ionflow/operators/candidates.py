"""Candidate formulas of molecules: distinct mass searches, union, support, pre-rank and cap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionflow.config import EngineConfig
from ionflow.constants import ELEMENTS, MASS
from ionflow.functions import chemistry as C
from ionflow.operators import kernel
from ionflow.sources import tables

#: Alike molecules that are taken together.
ALIKE = 256


def windows(spectra: DataFrame, config: EngineConfig) -> DataFrame:
    """target and tol of each distinct (precursor_mz, adduct): the neutral masses within precursor_ppm of theory."""
    f = config.precursor_ppm * 1e-6
    low = C.neutral_mass(F.col("precursor_mz") / F.lit(1 + f), F.col("shift"))
    high = C.neutral_mass(F.col("precursor_mz") / F.lit(1 - f), F.col("shift"))
    keys = spectra.select("precursor_mz", "adduct", "shift", "delta").distinct()
    return keys.withColumn("target", (low + high) / 2).withColumn("tol", (high - low) / 2)


def search_kernel(searches: DataFrame, config: EngineConfig) -> DataFrame:
    """(target, tol, vector, exceeded) by the numpy lattice: one row a formula, or one row exceeded."""
    tables.ship(searches.sparkSession)
    limits, most = config.limits, config.max_search_results

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = kernel.Lattice(limits)
        for b in batches:
            for target, tol in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    v, over = lattice.search(target, tol, most), False
                except kernel.SearchLimit:
                    v, over = np.zeros((0, 10), np.int64), True
                n = max(len(v), int(over))
                if n:
                    ends = pa.array(np.arange(n + 1) * (0 if over else 10), pa.int32())
                    vec = pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32).ravel()))
                    yield pa.record_batch([pa.array(np.full(n, target)), pa.array(np.full(n, tol)), vec, pa.array(np.full(n, over))], names=["target", "tol", "vector", "exceeded"])

    parts = max(1, int(searches.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = searches.select("target", "tol").distinct().repartition(parts, "target")
    return keys.mapInArrow(run, "target double, tol double, vector array<int>, exceeded boolean")


def _counts(df: DataFrame, elements: tuple[str, ...], limits: dict, top: float) -> DataFrame:
    for e in elements:
        most = min(limits.get(e, 0), int(top // MASS[e]))
        df = df.withColumn(e, F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("m", F.col("m") + F.col(e) * F.lit(MASS[e])).where(F.col("m") <= top)
    return df


def search_join(searches: DataFrame, config: EngineConfig, top: float) -> DataFrame:
    """(target, tol, vector) as an equi-join on residue buckets, for targets up to top: no Python.

    A search minus a C, N, O part leaves a mass which another part matches up to
    whole hydrogens, so that both fall into neighbouring buckets of the mass
    modulo hydrogen. Buckets are as wide as the widest tolerance.
    """
    spark, h = searches.sparkSession, MASS["H"]
    limits = config.element_limits
    keys = searches.select("target", "tol").distinct().where("target > 0")
    one = spark.range(1).select(F.lit(0.0).alias("m"))
    a = _counts(one, ("C", "N", "O"), limits, top + 1).withColumnRenamed("m", "ma")
    b = _counts(one, ("P", "S", "F", "Cl", "Br", "I"), limits, top + 1).withColumnRenamed("m", "mb")
    widest = keys.agg(F.max("tol")).first()[0] or 1e-3
    n = max(1, int(h // (1.01 * widest)))
    w = h / n
    left = F.col("target") - F.col("ma")
    x = keys.join(a, F.col("ma") <= F.col("target") + F.col("tol") + 1e-9)
    near = F.array(*(F.lit(d) for d in ((-1, 0, 1) if n >= 3 else (0,))))
    key = F.floor(F.pmod(left, F.lit(h)) / w).cast("int")
    if n >= 3:
        x = x.withColumn("key", F.explode(F.transform(near, lambda d: F.pmod(key + d, F.lit(n)))))
        x = x.join(b.withColumn("key", F.least(F.floor(F.pmod(F.col("mb"), F.lit(h)) / w).cast("int"), F.lit(n - 1))), "key")
    else:  # tolerances near a hydrogen's mass: every pair is looked at
        x = x.join(b, F.col("mb") <= left + F.col("tol") + 1e-9)
    rest = left - F.col("mb")
    low = F.greatest(F.ceil((rest - F.col("tol") - 1e-10) / h), F.lit(0))
    high = F.least(F.floor((rest + F.col("tol") + 1e-10) / h), F.lit(limits.get("H", 0)))
    x = x.withColumn("lo", low).withColumn("hi", high).where("hi >= lo").withColumn("H", F.explode(F.sequence("lo", "hi")))
    x = x.where(F.abs(left - F.col("mb") - F.col("H") * F.lit(h)) <= F.col("tol") + 1e-9)
    x = x.withColumn("vector", F.array(*(F.col(e).cast("int") for e in ELEMENTS)))
    return x.where(F.exists("vector", lambda k: k > 0)).select("target", "tol", "vector", F.lit(False).alias("exceeded"))


def twins(spectra: DataFrame) -> DataFrame:
    """(molecule_id, masses, like, deal): like is the first of the molecules with the same precursors and adducts, whose candidates are its own too.

    masses: spectrum_id, precursor_mz and shift of each spectrum, by spectrum_id.
    deal: 0, or where many molecules are alike one of several numbers, so that
    they spread over tasks. Written once.
    """
    own = F.array_sort(F.collect_list(F.struct("precursor_mz", "adduct"))).alias("key")
    masses = F.array_sort(F.collect_list(F.struct("spectrum_id", "precursor_mz", "shift"))).alias("masses")
    x = tables.materialize(spectra.where("molecule_id is not null").groupBy("molecule_id").agg(own, masses), "masses")
    first = x.groupBy("key").agg(F.min("molecule_id").alias("like"), F.ceil(F.count("*") / ALIKE).alias("hands"))
    deal = F.pmod(F.xxhash64("molecule_id"), "hands").cast("int").alias("deal")
    return tables.materialize(x.join(first, "key").select("molecule_id", "masses", "like", deal), "twins")


def lists(spectra: DataFrame, config: EngineConfig, search=search_kernel) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The molecules (as twins gives them), the candidates of each like as one array by pre_rank, and the molecules one of whose searches exceeds its limit.

    Each distinct set of masses is searched, counted and ranked once. A list has max_candidates at most.
    """
    own = twins(spectra)
    ids = own.where("molecule_id = like").select("molecule_id")
    found, over = _searched(spectra.join(ids, "molecule_id", "left_semi"), config, search)
    item = F.struct("pre_rank", *(c for c in found.columns if c not in ("molecule_id", "pre_rank")))
    by = found.groupBy(F.col("molecule_id").alias("like")).agg(F.array_sort(F.collect_list(item)).alias("cands"))
    over = own.join(over.withColumnRenamed("molecule_id", "like"), "like").select("molecule_id")
    return own, tables.materialize(by, "candidates"), over


def mass_errors(mass: Column, masses: Column) -> Column:
    """Of one candidate: spectrum_id to the error in ppm."""
    return F.map_from_entries(F.transform(masses, lambda s: F.struct(s["spectrum_id"], C.ppm(s["precursor_mz"], C.mz(mass, s["shift"])))))


def candidates(spectra: DataFrame, config: EngineConfig, search=search_kernel) -> tuple[DataFrame, DataFrame]:
    """Ranked and capped candidates, and the molecules one of whose searches exceeds its limit.

    spectra: normalised, without repeats. Candidates: molecule_id, vector, formula,
    mass, support, mean_abs_ppm, n_spectra, pre_rank, total.
    """
    own, by, over = lists(spectra, config, search)
    x = own.join(by, "like").select("molecule_id", "masses", F.inline("cands"))
    return x.withColumn("mass_errors_ppm", mass_errors(F.col("mass"), F.col("masses"))).drop("masses"), over


def _searched(spectra: DataFrame, config: EngineConfig, search) -> tuple[DataFrame, DataFrame]:
    """candidates of molecules of which no two are alike, without the errors of each spectrum."""
    keys = windows(spectra, config)
    hits = search(keys, config)
    found = keys.join(hits, ["target", "tol"])
    own = spectra.select("molecule_id", "precursor_mz", "adduct").distinct()
    over = own.join(found.where("exceeded").select("precursor_mz", "adduct").distinct(), ["precursor_mz", "adduct"]).select("molecule_id").distinct()
    good = found.where(~F.col("exceeded")).where(C.feasible(C.ion_counts(F.col("vector"), F.col("delta")))).select("precursor_mz", "adduct", "vector")
    union = own.join(good, ["precursor_mz", "adduct"]).select("molecule_id", "vector").distinct().join(over, "molecule_id", "left_anti")
    union = union.withColumn("mass", C.exact_mass(F.col("vector")))
    pairs = union.join(spectra.select("molecule_id", "precursor_mz", "shift", "delta"), "molecule_id")
    error = C.ppm(F.col("precursor_mz"), C.mz(F.col("mass"), F.col("shift")))
    pairs = pairs.withColumn("ppm", error)
    pairs = pairs.withColumn("supports", (F.abs("ppm") <= config.precursor_ppm + 1e-6) & C.feasible(C.ion_counts(F.col("vector"), F.col("delta"))))
    by = pairs.groupBy("molecule_id", "vector", "mass").agg(
        F.count_if("supports").alias("support"),
        F.avg(F.abs("ppm")).alias("mean_abs_ppm"),
        F.count("*").alias("n_spectra"),
    )
    by = by.withColumn("formula", C.format_formula(F.col("vector")))
    mol = W.partitionBy("molecule_id")
    rank = F.row_number().over(mol.orderBy(F.desc("support"), F.round("mean_abs_ppm", 9), "formula"))
    by = by.withColumn("pre_rank", rank).withColumn("total", F.count("*").over(mol)).withColumn("any_full", F.max(F.col("support") == F.col("n_spectra")).over(mol))
    return by.where(F.col("pre_rank") <= config.max_candidates), over

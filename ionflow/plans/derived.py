"""Spectra derived from the star schema: a spectrum an order, a molecule four orders, a peak a lineitem.

The same rules stand twice: as DataFrame expressions for the queries, and as
SQL text (SQL) that their oracles begin with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionflow.constants import ADDUCTS, shift
from ionflow.functions import chemistry as C
from ionflow.sources import files

#: Labels by molecule; the last is none.
FORMULAS = ("C6H12O6", "C5H10O5", "C9H8O4", "C2H6O", "C6H13O6+")
_MASSES = [C.mass_of(C.parse(f.rstrip("+")) if f[-1] != "+" else C.parse("C6H12O6")) for f in FORMULAS]
_NAMES = [a[0] for a in ADDUCTS] + ["[2M+H]+"]
_SHIFTS = [shift(d, z) for _, d, z in ADDUCTS] + [1.0]
_CHARGES = [z for _, _, z in ADDUCTS] + [1]


def _pick(k, values, kind):
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), (k + 1).cast("int"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw library rows with row_ord."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    # peaks stand in the table's order, in which intensities of equal m/z are then added
    line = files.numbered(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    peak = F.struct("row_ord", (F.lit(40) + F.col("l_partkey") % 120).cast("double").alias("mz"), (F.col("l_quantity") / F.lit(50.0)).alias("i"))
    peaks = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(peak)).alias("p"))
    k = F.col("o_orderkey")
    o = o.withColumn("g", F.floor(k / 4).cast("long"))
    o = o.withColumn("a", k % 11).withColumn("f", F.when(F.col("g") % 17 == 0, F.col("o_custkey") % 4).otherwise(F.col("g") % 5))
    o = o.join(peaks, k == F.col("l_orderkey"), "left")
    none = F.array().cast("array<double>")
    theory = _pick(F.col("f"), _MASSES, "double") + _pick(F.col("a"), _SHIFTS, "double")
    pos = _pick(F.col("a"), _CHARGES, "int") > 0
    return o.select(
        F.when(F.col("g") % 23 == 0, None).when(F.col("g") % 29 == 0, "").otherwise(F.concat(F.lit("K"), "g")).alias("inchikey14"),
        _pick(F.col("f"), FORMULAS, "string").alias("molecular_formula"),
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderstatus")).alias("ingest_lib"),
        (theory * (1 + (k % 51 - F.lit(24.7)) * F.lit(1e-6))).alias("precursor_mz"),
        _pick(F.col("a"), _NAMES, "string").alias("adduct"),
        F.when(k % 31 == 0, "positive").when(k % 3 == 0, None).when(pos, "positive").otherwise("negative").alias("ionization_mode"),
        F.coalesce(F.transform("p", lambda x: x["mz"]), none).alias("ms2_mzs"),
        F.coalesce(F.transform("p", lambda x: x["i"]), none).alias("ms2_normalized_intensities"),
        ((k % 61 - 24.5).cast("double")).alias("precursor_error_ppm"),
        F.when(k % 5 == 0, None).otherwise(F.array((10 + k % 7).cast("double"), (20 + k % 3).cast("double"))).alias("collision_energy_ev"),
        F.when(k % 7 != 0, (500 + (k % 13) * 100).cast("double")).alias("base_peak_intensity"),
        F.when(F.col("o_orderpriority").startswith("1"), "timsTOF Pro").when(F.col("o_orderpriority").startswith("2"), "Orbitrap").when(F.col("o_orderpriority").startswith("4"), "QTOF").alias("instrument_type"),
        F.concat(F.lit("M"), "g").alias("molecule_id"),
        F.when(k % 6 != 0, F.concat(F.lit("S"), k)).alias("spectrum_id"),
        k.alias("row_ord"),
    )


def _case(k: str, values, quote=False) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN " + (f"'{v}'" if quote else repr(v)) for i, v in enumerate(values)) + " END"


#: The rules again: tables spec (a row a spectrum) and peak (a row a peak).
SQL = f"""WITH ord AS (
  SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderpriority, o_orderkey // 4 AS g, o_orderkey % 11 AS a,
         CASE WHEN (o_orderkey // 4) % 17 = 0 THEN o_custkey % 4 ELSE (o_orderkey // 4) % 5 END AS f FROM orders),
spec AS (
  SELECT k AS row_ord, g, a, f,
    CASE WHEN g % 23 = 0 THEN NULL WHEN g % 29 = 0 THEN '' ELSE 'K' || g END AS inchikey14,
    {_case('f', FORMULAS, True)} AS molecular_formula,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS ingest_lib,
    (({_case('f', _MASSES)})::DOUBLE + ({_case('a', _SHIFTS)})::DOUBLE) * (1 + (k % 51 - 24.7::DOUBLE) * 1e-6::DOUBLE) AS precursor_mz,
    ({_case('f', _MASSES)})::DOUBLE AS label_mass,
    ({_case('a', _SHIFTS)})::DOUBLE AS shift,
    {_case('a', _CHARGES)} AS charge,
    {_case('a', _NAMES, True)} AS adduct,
    CASE WHEN k % 31 = 0 THEN 'positive' WHEN k % 3 = 0 THEN NULL WHEN ({_case('a', _CHARGES)}) > 0 THEN 'positive' ELSE 'negative' END AS ionization_mode,
    (k % 61 - 24.5)::DOUBLE AS precursor_error_ppm,
    CASE WHEN k % 7 <> 0 THEN (500 + (k % 13) * 100)::DOUBLE END AS base_peak_intensity,
    CASE WHEN k % 5 = 0 THEN NULL ELSE (10 + k % 7)::DOUBLE END AS ce1, CASE WHEN k % 5 = 0 THEN NULL ELSE (20 + k % 3)::DOUBLE END AS ce2,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'timsTOF Pro' WHEN '2' THEN 'Orbitrap' WHEN '4' THEN 'QTOF' END AS instrument_type,
    'M' || g AS molecule_id, CASE WHEN k % 6 <> 0 THEN 'S' || k END AS spectrum_id
  FROM ord),
peak AS (
  SELECT l_orderkey AS row_ord, (40 + l_partkey % 120)::DOUBLE AS mz, l_quantity / 50.0::DOUBLE AS intensity FROM lineitem)
"""
#: Ion counts of label and adduct stay at or above zero (the fixed labels and adducts, by hand).
_VECTORS = [C.parse(f) for f in FORMULAS]
_BAD = [(i, j) for i, v in enumerate(_VECTORS) if v for j, (_, d, _) in enumerate(ADDUCTS) if any(n + d.get(e, 0) < 0 for e, n in zip(("C", "H", "N", "O", "P", "S", "F", "Cl", "Br", "I"), v))]
INFEASIBLE = " OR ".join(f"(f = {i} AND a = {j})" for i, j in _BAD) or "false"

"""Queries over the engine's operators on derived spectra, each with its SQL oracle where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ionflow.config import EngineConfig
from ionflow.constants import ADDUCTS, ELEMENTS, MASS
from ionflow.engine import FormulaEngine
from ionflow.functions import chemistry as C, hashing as H
from ionflow.operators import candidates as cand, compare, evaluate as ev, features as feat, quality as Q, quantiles, ranking, ranks, spectra as S, stats
from ionflow.plans import derived
from ionflow.sources import files, tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Small limits, which brute force over integer series can follow.
SMALL = EngineConfig(element_limits={"C": 10, "H": 24, "N": 2, "O": 8})
D = derived.SQL


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(x: Column | str, n: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, n)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scalars
@query(D + "SELECT DISTINCT inchikey14, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (SELECT inchikey14, ('0x' || substr(sha256('42:' || inchikey14), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM spec WHERE inchikey14 IS NOT NULL)")
def q_split(spark, sf_dir):
    x = derived.spectra(spark, sf_dir).where("inchikey14 is not null").select("inchikey14").distinct()
    return x.withColumn("split", H.split_for(F.col("inchikey14")))


@query(D + "SELECT DISTINCT molecule_id, (('0x' || substr(sha256(molecule_id), 1, 8))::BIGINT % 32)::INTEGER AS bucket FROM spec")
def q_bucket(spark, sf_dir):
    return derived.spectra(spark, sf_dir).select("molecule_id").distinct().withColumn("bucket", H.bucket_for(F.col("molecule_id")))


def _made(spark, sf_dir):
    """Formula strings built from parts: every seventh is broken, every fifth has no carbon, some repeat an element."""
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("C"), F.col("p_size"))), F.lit("O"), k % 9 + 2, F.lit("H"), k % 60 + 2, F.when(k % 3 == 0, "N").otherwise(""), F.when(k % 4 == 0, "Cl2").otherwise(""), F.when(k % 6 == 0, "O").otherwise(""), F.when(k % 7 == 0, "+").otherwise(""))
    return p.select("p_partkey", text.alias("text"))


_MADE = """WITH m AS (SELECT p_partkey, p_partkey % 7 = 0 AS bad, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS c, p_partkey % 60 + 2 AS h,
  CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS n, p_partkey % 9 + 2 + CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS o, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END AS cl FROM part),
t AS (SELECT *, CASE WHEN c = 0 THEN '' WHEN c = 1 THEN 'C' ELSE 'C' || c END AS tc, 'H' || h AS th, CASE WHEN n = 1 THEN 'N' ELSE '' END AS tn, 'O' || o AS te, CASE WHEN cl = 2 THEN 'Cl2' ELSE '' END AS tl FROM m) """


@query(_MADE + "SELECT p_partkey, CASE WHEN NOT bad THEN c END::INTEGER AS c, CASE WHEN NOT bad THEN h END::INTEGER AS h, CASE WHEN NOT bad THEN n END::INTEGER AS n, CASE WHEN NOT bad THEN o END::INTEGER AS o, CASE WHEN NOT bad THEN cl END::INTEGER AS cl FROM t")
def q_formula_parse(spark, sf_dir):
    x = _made(spark, sf_dir).withColumn("v", C.parse_formula(F.col("text")))
    at = {e: F.element_at("v", ELEMENTS.index(n) + 1) for e, n in (("c", "C"), ("h", "H"), ("n", "N"), ("o", "O"), ("cl", "Cl"))}
    return x.select("p_partkey", *(v.alias(e) for e, v in at.items()))


@query(_MADE + "SELECT p_partkey, CASE WHEN bad THEN NULL WHEN c > 0 THEN tc || th || tl || tn || te ELSE tl || th || tn || te END AS formula FROM t")
def q_formula_format(spark, sf_dir):
    return _made(spark, sf_dir).select("p_partkey", C.format_formula(C.parse_formula(F.col("text"))).alias("formula"))


@query(_MADE + f"SELECT p_partkey, round(c * {MASS['C']!r} + h * {MASS['H']!r}::DOUBLE + n * {MASS['N']!r}::DOUBLE + o * {MASS['O']!r}::DOUBLE + cl * {MASS['Cl']!r}::DOUBLE, 6) AS mass, (1 + c + (n - h - cl) / 2.0)::DOUBLE AS dbe, round(h::DOUBLE / greatest(c, 1), 6) AS h_c, round((n + o + cl)::DOUBLE / greatest(c, 1), 6) AS hetero_c FROM t WHERE NOT bad")
def q_formula_descriptors(spark, sf_dir):
    made = _made(spark, sf_dir)
    # each distinct text is parsed once; written, since the optimizer would repeat the parsing in every place that reads it
    v = tables.materialize(made.select("text").distinct().withColumn("v", C.parse_formula(F.col("text"))).where("v is not null"), "parsed")
    h_c, hetero = C.ratios(F.col("v"))
    each = v.select("text", _r(C.exact_mass(F.col("v"))).alias("mass"), C.dbe(F.col("v")).alias("dbe"), _r(h_c).alias("h_c"), _r(hetero).alias("hetero_c"))
    return made.join(each, "text").select("p_partkey", "mass", "dbe", "h_c", "hetero_c")


@query(D + f"SELECT DISTINCT molecular_formula, adduct, charge, round(label_mass + shift, 6) AS mz, round(label_mass, 6) AS neutral, NOT ({derived.INFEASIBLE}) AS feasible FROM spec WHERE f <> 4 AND a <> 10")
def q_adduct_mz(spark, sf_dir):
    x = C.with_adduct(derived.spectra(spark, sf_dir).select("molecular_formula", "adduct").distinct()).withColumn("v", C.parse_formula(F.col("molecular_formula"))).where("v is not null and charge is not null")
    mz = C.mz(C.exact_mass(F.col("v")), F.col("shift"))
    return x.select("molecular_formula", "adduct", "charge", _r(mz).alias("mz"), _r(C.neutral_mass(mz, F.col("shift"))).alias("neutral"), C.feasible(C.ion_counts(F.col("v"), F.col("delta"))).alias("feasible"))


@query(D + "SELECT row_ord, round((precursor_mz - (label_mass + shift)) / (label_mass + shift) * 1e6, 4) AS ppm FROM spec WHERE f <> 4 AND a <> 10")
def q_ppm(spark, sf_dir):
    x = C.with_adduct(derived.spectra(spark, sf_dir)).withColumn("v", C.parse_formula(F.col("molecular_formula"))).where("v is not null and charge is not null")
    return x.select("row_ord", _r(C.ppm(F.col("precursor_mz"), C.mz(C.exact_mass(F.col("v")), F.col("shift"))), 4).alias("ppm"))


# Audit
_NULLS = ("inchikey14", "ingest_lib", "ionization_mode", "base_peak_intensity", "instrument_type", "spectrum_id", "precursor_mz")


@query(D + "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in _NULLS) + " FROM spec")
def q_audit_nulls(spark, sf_dir):
    return Q.null_counts(derived.spectra(spark, sf_dir).select(*_NULLS))


@query(D + "SELECT adduct, count(*) AS n FROM spec GROUP BY adduct")
def q_audit_adducts(spark, sf_dir):
    return derived.spectra(spark, sf_dir).groupBy("adduct").agg(F.count("*").alias("n"))


@query(D + ", c AS (SELECT s.row_ord, count(p.row_ord) AS n FROM spec s LEFT JOIN peak p USING (row_ord) GROUP BY 1) SELECT 0::BIGINT AS misaligned, count(*) FILTER (WHERE n = 0) AS empty, median(n) AS median, max(n)::INTEGER AS max FROM c")
def q_audit_peaks(spark, sf_dir):
    return Q.peak_stats(derived.spectra(spark, sf_dir))


@query(D + ", e AS (SELECT ingest_lib, abs(precursor_error_ppm) AS e, row_number() OVER (PARTITION BY ingest_lib ORDER BY abs(precursor_error_ppm)) AS i, count(*) OVER (PARTITION BY ingest_lib) AS n FROM spec) SELECT ingest_lib, count(*) AS spectra, median(e) AS provided_error_median_ppm, max(e) FILTER (WHERE i = round((n - 1) * 0.99::DOUBLE) + 1) AS provided_error_p99_ppm FROM e GROUP BY ingest_lib")
def q_audit_sources(spark, sf_dir):
    return Q.source_stats(derived.spectra(spark, sf_dir))


@query(D + "SELECT count(DISTINCT inchikey14) + max((inchikey14 IS NULL)::INTEGER) AS structures, count(DISTINCT molecular_formula) AS formulas, count(*) FILTER (WHERE f <> 4) AS supported FROM spec")
def q_audit_distinct(spark, sf_dir):
    x = derived.spectra(spark, sf_dir).withColumn("ok", C.parse_formula(F.col("molecular_formula")).isNotNull())
    return x.agg(Q.n_unique("inchikey14").cast("long").alias("structures"), F.count_distinct("molecular_formula").alias("formulas"), F.count_if("ok").alias("supported"))


@query(D + "SELECT inchikey14 FROM spec WHERE inchikey14 IS NOT NULL GROUP BY inchikey14 HAVING count(DISTINCT molecular_formula) > 1")
def q_conflicts(spark, sf_dir):
    return Q.conflicts(derived.spectra(spark, sf_dir))


JUDGED = D + f""", bad AS (SELECT inchikey14 FROM spec WHERE inchikey14 IS NOT NULL GROUP BY inchikey14 HAVING count(DISTINCT molecular_formula) > 1),
j AS (SELECT s.*, coalesce(s.ingest_lib, 'unknown') AS source, CASE
  WHEN coalesce(s.inchikey14, '') = '' THEN 'missing_structure_id'
  WHEN b.inchikey14 IS NOT NULL THEN 'conflicting_structure'
  WHEN f = 4 THEN 'unsupported_formula' WHEN a = 10 THEN 'unsupported_adduct'
  WHEN {derived.INFEASIBLE} THEN 'invalid_ion_composition'
  WHEN abs((precursor_mz - (label_mass + shift)) / (label_mass + shift) * 1e6) > 20 THEN 'precursor_error_gt20ppm'
  WHEN ionization_mode IS NOT NULL AND ionization_mode <> CASE WHEN charge > 0 THEN 'positive' ELSE 'negative' END THEN 'invalid_spectrum' END AS reason,
  ('0x' || substr(sha256('42:' || s.inchikey14), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u
  FROM spec s LEFT JOIN bad b ON s.inchikey14 = b.inchikey14),
acc AS (SELECT *, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM j WHERE reason IS NULL)
"""


def _judged(spark, sf_dir):
    return Q.judged(derived.spectra(spark, sf_dir), EngineConfig())


@query(JUDGED + "SELECT coalesce(reason, 'accepted') AS reason, source, count(*) AS spectra FROM j GROUP BY GROUPING SETS ((coalesce(reason, 'accepted'), source), (coalesce(reason, 'accepted')))")
def q_reject_cascade(spark, sf_dir):
    return Q.tallies(_judged(spark, sf_dir)).select("reason", "source", "spectra")


@query(JUDGED + "SELECT row_ord, split FROM acc")
def q_accepted(spark, sf_dir):
    return _judged(spark, sf_dir).where("reason is null").select("row_ord", "split")


_COUNTS = {e: [v[ELEMENTS.index(e)] if v else 0 for v in derived._VECTORS] for e in ("C", "H", "O")}


@query(JUDGED + "SELECT " + ", ".join(f"ceil(max({derived._case('f', _COUNTS[e])}) FILTER (WHERE split = 'train') * 1.2::DOUBLE)::INTEGER AS {e.lower()}" for e in "CHO") + ", 0::INTEGER AS n FROM acc")
def q_element_limits(spark, sf_dir):
    x = Q.element_limits(_judged(spark, sf_dir).where("reason is null"))
    return x.select(F.col("C").alias("c"), F.col("H").alias("h"), F.col("O").alias("o"), F.col("N").alias("n"))


@query(JUDGED + "SELECT split, count(DISTINCT f) AS unique_formulas, count(DISTINCT f) FILTER (WHERE f IN (1, 3)) AS within_element_limits FROM acc GROUP BY split")
def q_coverage(spark, sf_dir):
    limits = dict.fromkeys(ELEMENTS, 0) | {"C": 5, "H": 10, "O": 5}
    return Q.coverage(_judged(spark, sf_dir).where("reason is null"), limits)


# Spectra
@query(D + "SELECT row_ord, CASE WHEN a = 10 THEN 'unsupported_input' WHEN ionization_mode IS NOT NULL AND ionization_mode <> CASE WHEN charge > 0 THEN 'positive' ELSE 'negative' END THEN 'invalid_input' END AS status FROM spec")
def q_validation(spark, sf_dir):
    return S.normalize(derived.spectra(spark, sf_dir), EngineConfig()).select("row_ord", "status")


def _peaks_sql(floor: float, most: int) -> str:
    return D + f""", s AS (SELECT p.row_ord, mz, sum(intensity) AS i FROM peak p JOIN spec USING (row_ord) WHERE a <> 10 AND NOT (ionization_mode IS NOT NULL AND ionization_mode <> CASE WHEN charge > 0 THEN 'positive' ELSE 'negative' END) GROUP BY 1, 2),
    n AS (SELECT row_ord, mz, i / max(i) OVER (PARTITION BY row_ord) AS i FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY row_ord ORDER BY i DESC, mz) AS k FROM n WHERE i >= {floor}::DOUBLE AND i > 0)
    SELECT row_ord, mz, round(i, 6) AS intensity FROM r WHERE k <= {most}"""


def _peaks(spark, sf_dir, config):
    x = S.normalize(derived.spectra(spark, sf_dir), config).where("status is null")
    return x.select("row_ord", F.explode("peaks").alias("p")).select("row_ord", "p.mz", _r("p.intensity").alias("intensity"))


@query(_peaks_sql(0.001, 128))
def q_normalize_peaks(spark, sf_dir):
    return _peaks(spark, sf_dir, EngineConfig())


@query(_peaks_sql(0.25, 2))
def q_strongest_peaks(spark, sf_dir):
    return _peaks(spark, sf_dir, EngineConfig(intensity_floor=0.25, max_peaks=2))


@query(D + "SELECT row_ord, coalesce(spectrum_id, 'spectrum_' || (row_number() OVER (PARTITION BY molecule_id ORDER BY row_ord) - 1)) AS spectrum_id FROM spec")
def q_spectrum_ids(spark, sf_dir):
    return S.with_ids(derived.spectra(spark, sf_dir)).select("row_ord", "spectrum_id")


@query(D + "SELECT row_ord FROM spec")
def q_drop_repeats(spark, sf_dir):
    x = derived.spectra(spark, sf_dir)
    again = x.where("row_ord % 3 = 0").withColumn("row_ord", F.col("row_ord") + 10**9).withColumn("spectrum_id", F.lit("again"))
    return S.drop_repeats(x.unionByName(again)).select("row_ord")


@query(D + "SELECT row_ord, round((ce1 + ce2) / 2, 6) AS ce_mean, least(ce1, ce2) AS ce_min, greatest(ce1, ce2) AS ce_max FROM spec WHERE a <> 10 AND NOT (ionization_mode IS NOT NULL AND ionization_mode <> CASE WHEN charge > 0 THEN 'positive' ELSE 'negative' END)")
def q_collision_energy(spark, sf_dir):
    return S.normalize(derived.spectra(spark, sf_dir), EngineConfig()).where("status is null").select("row_ord", _r("ce_mean").alias("ce_mean"), "ce_min", "ce_max")


_CLEAN = D + """, k AS (SELECT s.row_ord, count(p.row_ord) FILTER (WHERE p.mz <= precursor_mz + 2.0) AS kept, count(p.row_ord) FILTER (WHERE p.mz > precursor_mz + 2.0) AS peaks_removed
 FROM spec s LEFT JOIN peak p USING (row_ord) WHERE {} GROUP BY s.row_ord) SELECT row_ord, kept::INTEGER AS kept, peaks_removed::INTEGER AS peaks_removed FROM k"""


@query(_CLEAN.format("base_peak_intensity >= 1000"))
def q_clean_strict(spark, sf_dir):
    return S.clean_by_rule(derived.spectra(spark, sf_dir)).select("row_ord", F.size("ms2_mzs").alias("kept"), "peaks_removed")


@query(_CLEAN.format("base_peak_intensity IS NULL OR base_peak_intensity >= 1000"))
def q_clean_lenient(spark, sf_dir):
    return S.clean_by_rule(derived.spectra(spark, sf_dir), keep_unknown_base=True).select("row_ord", F.size("ms2_mzs").alias("kept"), "peaks_removed")


@query(_CLEAN.format("true"))
def q_clean_peaks_only(spark, sf_dir):
    return S.clean_by_rule(derived.spectra(spark, sf_dir), gate=False).select("row_ord", F.size("ms2_mzs").alias("kept"), "peaks_removed")


@query(D + "SELECT row_ord, coalesce(lower(instrument_type) LIKE '%timstof%', false) AS timstof, coalesce(lower(instrument_type) LIKE '%orbitrap%', false) AS orbitrap, instrument_type IS NULL AS missing, round(ln(1 + coalesce(base_peak_intensity, 0)), 6) AS log_base FROM spec")
def q_instrument(spark, sf_dir):
    low = F.lower("instrument_type")
    return derived.spectra(spark, sf_dir).select("row_ord", F.coalesce(low.contains("timstof"), F.lit(False)).alias("timstof"), F.coalesce(low.contains("orbitrap"), F.lit(False)).alias("orbitrap"), (F.coalesce("instrument_type", F.lit("")) == "").alias("missing"), _r(F.log1p(F.coalesce("base_peak_intensity", F.lit(0.0)))).alias("log_base"))


# Search and candidates
_LATTICE = f""", lat AS (SELECT c::INTEGER AS c, h::INTEGER AS h, n::INTEGER AS n, o::INTEGER AS o, c * {MASS['C']!r}::DOUBLE + h * {MASS['H']!r}::DOUBLE + n * {MASS['N']!r}::DOUBLE + o * {MASS['O']!r}::DOUBLE AS m
  FROM generate_series(0, 10) t1(c), generate_series(0, 24) t2(h), generate_series(0, 2) t3(n), generate_series(0, 8) t4(o) WHERE c + h + n + o > 0),
win AS (SELECT DISTINCT precursor_mz, adduct, shift, a, (precursor_mz / (1 + 10 * 1e-6::DOUBLE) - shift + precursor_mz / (1 - 10 * 1e-6::DOUBLE) - shift) / 2 AS target,
  (precursor_mz / (1 - 10 * 1e-6::DOUBLE) - precursor_mz / (1 + 10 * 1e-6::DOUBLE)) / 2 AS tol FROM spec WHERE a <> 10)
"""


def _all(spark, sf_dir, config):
    """Every molecule's spectra, normalised."""
    return S.normalize(S.with_ids(derived.spectra(spark, sf_dir)), config).where("charge is not null")


_HITS = D + _LATTICE + "SELECT DISTINCT round(w.target, 6) AS target, c, h, n, o FROM win w JOIN lat ON w.target > 0 AND abs(m - w.target) <= w.tol + 1e-9"


def _search(spark, sf_dir, search):
    keys = cand.windows(_all(spark, sf_dir, SMALL), SMALL)
    hits = search(keys).where("not exceeded")
    return hits.select(_r("target").alias("target"), *(F.element_at("vector", k + 1).alias(e) for k, e in enumerate("chno"))).distinct()


@query(_HITS)
def q_enumerate(spark, sf_dir):
    return _search(spark, sf_dir, lambda k: cand.search_kernel(k, SMALL))


@query(_HITS)
def q_enumerate_join(spark, sf_dir):
    return _search(spark, sf_dir, lambda k: cand.search_join(k, SMALL, 400.0))


_DELTA = {e: [d.get(e, 0) for _, d, _ in ADDUCTS] for e in ("C", "H", "N", "O")}
_OK = " AND ".join(f"{x} + ({derived._case('s.a', _DELTA[e])}) >= 0" for e, x in (("C", "l.c"), ("H", "l.h"), ("N", "l.n"), ("O", "l.o")))
_OKW = _OK.replace("s.a", "w.a")
_CANDS = D + _LATTICE + f""", sp AS (SELECT molecule_id, coalesce(spectrum_id, 'x' || row_ord) AS sid, row_ord, precursor_mz, adduct, shift, a, charge FROM spec WHERE a <> 10),
hit AS (SELECT DISTINCT w.precursor_mz, w.adduct, l.c, l.h, l.n, l.o, l.m FROM win w JOIN lat l ON w.target > 0 AND abs(l.m - w.target) <= w.tol + 1e-9 WHERE {_OKW}),
un AS (SELECT DISTINCT sp.molecule_id, c, h, n, o, m FROM sp JOIN hit USING (precursor_mz, adduct)),
pr AS (SELECT l.molecule_id, l.c, l.h, l.n, l.o, l.m, s.row_ord, (s.precursor_mz - (l.m + s.shift)) / (l.m + s.shift) * 1e6 AS ppm, ({_OK}) AS ok FROM un l JOIN sp s ON l.molecule_id = s.molecule_id),
cd AS (SELECT molecule_id, c, h, n, o, m, count(*) FILTER (WHERE ok AND abs(ppm) <= 10 + 1e-6) AS support, avg(abs(ppm)) AS err, count(*) AS n_spectra,
  CASE WHEN c > 0 THEN CASE WHEN c = 1 THEN 'C' ELSE 'C' || c END ELSE '' END || CASE WHEN h = 0 THEN '' WHEN h = 1 THEN 'H' ELSE 'H' || h END || CASE WHEN n = 0 THEN '' WHEN n = 1 THEN 'N' ELSE 'N' || n END || CASE WHEN o = 0 THEN '' WHEN o = 1 THEN 'O' ELSE 'O' || o END AS formula
  FROM pr GROUP BY 1, 2, 3, 4, 5, 6),
rk AS (SELECT *, row_number() OVER (PARTITION BY molecule_id ORDER BY support DESC, round(err, 9), formula) AS pre_rank, count(*) OVER (PARTITION BY molecule_id) AS total FROM cd)
"""


def _cands(spark, sf_dir, config=SMALL):
    x = _all(spark, sf_dir, SMALL)
    return cand.candidates(x, config)[0], x


@query(_CANDS + "SELECT molecule_id, formula, round(m, 6) AS mass, support, round(err, 4) AS mean_abs_ppm, n_spectra, pre_rank::INTEGER AS pre_rank, total FROM rk")
def q_candidates(spark, sf_dir):
    return _cands(spark, sf_dir)[0].select("molecule_id", "formula", _r("mass").alias("mass"), "support", _r("mean_abs_ppm", 4).alias("mean_abs_ppm"), "n_spectra", "pre_rank", "total")


@query(_CANDS + "SELECT molecule_id, formula, pre_rank::INTEGER AS pre_rank, total > 2 AS truncated FROM rk WHERE pre_rank <= 2")
def q_candidate_cap(spark, sf_dir):
    x = _cands(spark, sf_dir, EngineConfig(element_limits=SMALL.element_limits, max_candidates=2))[0]
    return x.select("molecule_id", "formula", "pre_rank", (F.col("total") > 2).alias("truncated"))


@query(_CANDS + "SELECT molecule_id, bool_and(support < n_spectra) AND max(n_spectra) > 1 AS inconsistent FROM rk GROUP BY molecule_id")
def q_inconsistent(spark, sf_dir):
    x = _cands(spark, sf_dir)[0]
    return x.groupBy("molecule_id").agg((~F.max("any_full") & (F.max("n_spectra") > 1)).alias("inconsistent"))


# Fragments: single-atom-range brute force over the lattice of parts
#: The one atom outside the lattice that three adducts bring: number, mass, adduct.
_EXTRA = ", ".join(f"({k + 1}, {MASS[e]!r}::DOUBLE, {i})" for k, (i, e) in enumerate((i, e) for i, (_, d, _) in enumerate(ADDUCTS) for e in ("Na", "K", "Cl") if d.get(e, 0) > 0))
_EVID = _CANDS + f""", valid AS (SELECT DISTINCT pr.molecule_id, pr.row_ord, pr.c, pr.h, pr.n, pr.o, pr.m, sp.charge,
   sp.a, pr.c + ({derived._case('sp.a', _DELTA['C'])}) AS ic, pr.h + ({derived._case('sp.a', _DELTA['H'])}) AS ih, pr.n + ({derived._case('sp.a', _DELTA['N'])}) AS i_n, pr.o + ({derived._case('sp.a', _DELTA['O'])}) AS io
   FROM pr JOIN sp USING (row_ord) WHERE pr.ok),
ps AS (SELECT row_ord, mz, sum(intensity) AS i FROM peak GROUP BY 1, 2),
pn AS (SELECT row_ord, mz, i / max(i) OVER (PARTITION BY row_ord) AS i FROM ps),
pk AS (SELECT pn.*, greatest(0.5::DOUBLE, mz * 1e-5) AS tol FROM pn JOIN sp USING (row_ord) WHERE pn.i >= 0.001),
extra AS (SELECT * FROM (VALUES (0, 0::DOUBLE, NULL), {_EXTRA}) t(z, zm, za)),
part_ AS (SELECT c, h, n, o, za, c * {MASS['C']!r}::DOUBLE + h * {MASS['H']!r}::DOUBLE + n * {MASS['N']!r}::DOUBLE + o * {MASS['O']!r}::DOUBLE + zm AS m
  FROM generate_series(0, 11) t1(c), generate_series(0, 28) t2(h), generate_series(0, 3) t3(n), generate_series(0, 10) t4(o), extra WHERE c + h + n + o + z > 0),
mt AS (SELECT v.molecule_id, v.row_ord, v.c, v.h, v.n, v.o, k.mz, k.i, min(abs(q.m - (k.mz + v.charge * 0.000548579909065::DOUBLE)) / k.tol) AS e,
   arg_min(v.ic - q.c || ',' || v.ih - q.h || ',' || v.i_n - q.n || ',' || v.io - q.o || ',' || (q.za IS NULL AND v.a IN (SELECT za FROM extra WHERE za IS NOT NULL)), abs(q.m - (k.mz + v.charge * 0.000548579909065::DOUBLE)) / k.tol) AS lost
   FROM valid v JOIN pk k ON k.row_ord = v.row_ord JOIN part_ q ON abs(q.m - (k.mz + v.charge * 0.000548579909065::DOUBLE)) <= k.tol * (1 + 1e-8) AND (q.za IS NULL OR q.za = v.a) AND q.c <= v.ic AND q.h <= v.ih AND q.n <= v.i_n AND q.o <= v.io GROUP BY ALL),
sm AS (SELECT row_ord, count(*) AS np, sum(i) AS ti FROM pk GROUP BY 1)
"""


#: What of the ion the best part of a peak leaves, as counts and whether the adduct's own atom is among it.
_LOST = {"water": "0,2,0,1,false", "co": "1,0,0,1,false", "co2": "1,0,0,2,false", "ammonia": "0,3,1,0,false"}


@query(_EVID + "SELECT v.molecule_id, v.row_ord, v.c, v.h, v.n, v.o, round(coalesce(count(mt.mz)::DOUBLE / max(sm.np), 0), 9) AS peak_fraction, round(coalesce(sum(mt.i) / max(sm.ti), 0), 9) AS intensity_fraction, round(coalesce(avg(mt.e), 1), 6) AS fragment_error_fraction, "
    + ", ".join(f"round(coalesce(sum(mt.i) FILTER (WHERE mt.lost = '{x}') / max(sm.ti), 0), 9) AS {n}_loss_fraction" for n, x in _LOST.items())
    + " FROM valid v LEFT JOIN mt ON v.row_ord = mt.row_ord AND v.c = mt.c AND v.h = mt.h AND v.n = mt.n AND v.o = mt.o LEFT JOIN sm ON sm.row_ord = v.row_ord GROUP BY 1, 2, 3, 4, 5, 6")
def q_fragment_evidence(spark, sf_dir):
    config = EngineConfig(element_limits=SMALL.element_limits, fragment_da=0.5)
    raw = S.clean_peaks(S.merged_peaks(F.col("ms2_mzs"), F.col("ms2_normalized_intensities")), config)
    x = _all(spark, sf_dir, SMALL).select("molecule_id", F.col("row_ord").cast("string").alias("spectrum_id"), "precursor_mz", "adduct", "shift", "charge", "delta", raw.alias("peaks"))
    x = tables.materialize(x, "spectra")
    own, lists, _ = cand.lists(x, SMALL)
    e = feat.evidence_of_lists(own, lists, x, config).where("feasible and not exceeded")
    return e.select("molecule_id", F.col("spectrum_id").cast("long").alias("row_ord"), *(F.element_at("vector", k + 1).alias(n) for k, n in enumerate("chno")), *(_r(n, 6 if n == "fragment_error_fraction" else 9).alias(n) for n in feat.PER_SPECTRUM[2:9]))


@query("SELECT l_orderkey, l_linenumber, CASE (l_partkey % 6)::INTEGER WHEN 0 THEN 'water' WHEN 1 THEN 'co' WHEN 2 THEN 'co2' WHEN 3 THEN 'ammonia' END AS loss FROM lineitem")
def q_neutral_loss(spark, sf_dir):
    kinds = ([0, 2, 0, 1], [1, 0, 0, 1], [1, 0, 0, 2], [0, 3, 1, 0], [1, 4, 0, 0], [0, 0, 0, 0])
    vec = F.element_at(F.array(*(F.array(*(F.lit(n) for n in [*v, *[0] * 8])) for v in kinds)), (F.col("l_partkey") % 6 + 1).cast("int"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.loss_name(vec).alias("loss"))


# Ranks: lineitems stand for candidates of an order, scored by price
_RANKED = "WITH r AS (SELECT l_orderkey AS g, l_linenumber AS f, l_quantity AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS rank FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)), t AS (SELECT o_orderkey AS g, 1 + o_orderkey % 5 AS f, o_orderstatus AS source, o_custkey % 3 = 0 AS seen, o_totalprice / 500 AS mass FROM orders), x AS (SELECT t.*, r.rank FROM t LEFT JOIN r ON t.g = r.g AND t.f = r.f) "


def _ranked(spark, sf_dir):
    r = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("molecule_id"), F.col("l_linenumber").alias("formula")).agg(F.max("l_quantity").alias("score"))
    k = F.col("o_orderkey")
    t = _table(spark, sf_dir, "orders").select(k.alias("molecule_id"), (1 + k % 5).cast("int").alias("formula"), F.col("o_orderstatus").alias("source"), (F.col("o_custkey") % 3 == 0).alias("seen"), (F.col("o_totalprice") / 500).alias("neutral_mass"))
    return ranking.by_score(r), t


def _truth(spark, sf_dir):
    r, t = _ranked(spark, sf_dir)
    return ranking.truth_rank(r, t)


@query(_RANKED + "SELECT g AS molecule_id, f AS formula, s AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def q_top_k(spark, sf_dir):
    return ranking.top_k(_ranked(spark, sf_dir)[0], 3).select("molecule_id", "formula", "score", "rank")


@query(_RANKED + "SELECT g AS molecule_id, rank::INTEGER AS rank FROM x")
def q_truth_rank(spark, sf_dir):
    return _truth(spark, sf_dir).select("molecule_id", "rank")


@query(_RANKED + "SELECT g AS molecule_id, rank::BIGINT AS rank FROM x WHERE rank IS NOT NULL")
def q_rank_of_target(spark, sf_dir):
    r, t = _ranked(spark, sf_dir)
    x = r.join(t.select("molecule_id", F.col("formula").alias("truth")), "molecule_id").withColumn("label", (F.col("formula") == F.col("truth")).cast("int"))
    return ranking.rank_of_target(x, "molecule_id", "score", "label", "formula")


_M = "count(*) AS molecules, round(avg((rank IS NOT NULL)::INTEGER), 6) AS candidate_recall, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS top{k}" for k in ev.CUTS) + ", round(avg(CASE WHEN rank <= 25 THEN 1.0::DOUBLE / rank ELSE 0.0 END), 6) AS mrr25"
_MN = ["candidate_recall", *(f"top{k}" for k in ev.CUTS), "mrr25"]


def _rounded(df, names=_MN):
    return df.withColumns({n: _r(n) for n in names})


@query(_RANKED + f"SELECT {_M} FROM x")
def q_metrics(spark, sf_dir):
    return _rounded(ev.metrics(_truth(spark, sf_dir)))


@query(_RANKED + f", z AS (SELECT rank, unnest(['mode:' || CASE WHEN g % 2 = 0 THEN 'positive' ELSE 'negative' END, 'source:' || source, 'mass:' || CASE WHEN mass < 300 THEN '<300' WHEN mass < 600 THEN '300-600' ELSE '>=600' END, CASE WHEN seen THEN 'formula:seen' ELSE 'formula:unseen' END]) AS stratum FROM x) SELECT stratum, {_M} FROM z GROUP BY stratum")
def q_strata(spark, sf_dir):
    x = _truth(spark, sf_dir).withColumn("modes", F.array(F.when(F.col("molecule_id") % 2 == 0, "positive").otherwise("negative"))).withColumn("sources", F.array("source"))
    return _rounded(ev.stratified(x))


@query(_RANKED + ", m AS (SELECT source, count(*) AS n, avg((rank IS NOT NULL)::INTEGER) AS recall, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS top1, avg(CASE WHEN rank <= 25 THEN 1.0::DOUBLE / rank ELSE 0.0 END) AS mrr25 FROM x GROUP BY source) SELECT 'weighted' AS average, round(sum(recall * n / (SELECT sum(n) FROM m)), 6) AS candidate_recall, round(sum(top1 * n / (SELECT sum(n) FROM m)), 6) AS top1, round(sum(mrr25 * n / (SELECT sum(n) FROM m)), 6) AS mrr25 FROM m UNION ALL SELECT 'micro', round(avg((rank IS NOT NULL)::INTEGER), 6), round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6), round(avg(CASE WHEN rank <= 25 THEN 1.0::DOUBLE / rank ELSE 0.0 END), 6) FROM x")
def q_weighted(spark, sf_dir):
    x = _truth(spark, sf_dir)
    return _rounded(ev.weighted(x, ev.priors(x)).select("average", "candidate_recall", "top1", "mrr25"), ["candidate_recall", "top1", "mrr25"])


@query("SELECT round(avg((o_totalprice > 400000)::INTEGER), 6) AS no_candidate_rate, round(avg((o_orderkey % 9 = 0)::INTEGER), 6) AS truncation_rate, round(avg((o_custkey % 8 = 0)::INTEGER), 6) AS resource_limit_rate FROM orders")
def q_failure_rates(spark, sf_dir):
    x = _table(spark, sf_dir, "orders").select((F.col("o_totalprice") > 400000).alias("no_candidates"), (F.col("o_orderkey") % 9 == 0).alias("truncated"), (F.col("o_custkey") % 8 == 0).alias("resource_limited"))
    return _rounded(ev.rates(x), ["no_candidate_rate", "truncation_rate", "resource_limit_rate"])


@query(_RANKED + ", b AS (SELECT floor((row_number() OVER (ORDER BY g) - 1) / 300) + 1 AS batch, rank FROM x), m AS (SELECT batch, avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE / rank ELSE 0.0 END) AS v FROM b GROUP BY batch) SELECT round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max FROM m")
def q_batch_variation(spark, sf_dir):
    x = stats.batches(_truth(spark, sf_dir), "molecule_id", 300).groupBy("batch").agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("v"))
    return _rounded(stats.variation(x, "v"), ["mean", "sd", "min", "max"])


@query(_RANKED + "SELECT count(*) FILTER (WHERE 1.0 / coalesce(rank, 99) > 1.0 / f) AS improved, count(*) FILTER (WHERE 1.0 / coalesce(rank, 99) < 1.0 / f) AS worsened, count(*) AS pairs FROM x")
def q_paired_change(spark, sf_dir):
    delta = 1.0 / F.coalesce("rank", F.lit(99)) - 1.0 / F.col("formula")
    return _truth(spark, sf_dir).agg(F.count_if(delta > 0).alias("improved"), F.count_if(delta < 0).alias("worsened"), F.count("*").alias("pairs"))


# Sets, joins, samples
@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey")
def q_semi_ids(spark, sf_dir):
    ids = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return _table(spark, sf_dir, "orders").join(ids, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query(D + "SELECT DISTINCT molecule_id FROM spec WHERE molecule_id NOT IN (SELECT molecule_id FROM spec WHERE row_ord % 20 = 0)")
def q_resume(spark, sf_dir):
    x = derived.spectra(spark, sf_dir)
    return files.resume(x.select("molecule_id"), x.where("row_ord % 20 = 0")).distinct()


@query(D + "SELECT molecule_id, string_agg(DISTINCT coalesce(ingest_lib, 'unknown'), ',' ORDER BY coalesce(ingest_lib, 'unknown')) AS sources, min(molecular_formula) AS formula FROM spec GROUP BY molecule_id")
def q_molecule_groups(spark, sf_dir):
    x = derived.spectra(spark, sf_dir).withColumn("ingest_lib", F.coalesce("ingest_lib", F.lit("unknown")))
    return ev.groups_of(x).select("molecule_id", F.array_join("sources", ",").alias("sources"), "formula")


@query(D + "SELECT 'union' AS kind, count(*) AS n FROM (SELECT molecule_id FROM spec WHERE a = 1 UNION SELECT molecule_id FROM spec WHERE a = 2) UNION ALL SELECT 'except', count(*) FROM (SELECT DISTINCT molecule_id FROM spec WHERE a = 1 EXCEPT SELECT molecule_id FROM spec WHERE a = 2) UNION ALL SELECT 'intersect', count(*) FROM (SELECT molecule_id FROM spec WHERE a = 1 INTERSECT SELECT molecule_id FROM spec WHERE a = 2)")
def q_set_operations(spark, sf_dir):
    x = derived.spectra(spark, sf_dir)
    a, b = (x.where(F.col("row_ord") % 11 == k).select("molecule_id") for k in (1, 2))
    made = (("union", a.union(b).distinct()), ("except", a.subtract(b)), ("intersect", a.intersect(b)))
    out = None
    for kind, df in made:
        row = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.union(row)
    return out


@query(D + ", i AS (SELECT DISTINCT (('0x' || substr(sha256(molecule_id), 1, 8))::BIGINT % 32) AS b, molecule_id FROM spec), r AS (SELECT *, row_number() OVER (ORDER BY b, molecule_id) AS k FROM i) SELECT molecule_id, count(*) AS spectra FROM spec WHERE molecule_id IN (SELECT molecule_id FROM r WHERE k <= 100) GROUP BY molecule_id")
def q_first_groups(spark, sf_dir):
    x = derived.spectra(spark, sf_dir).withColumn("bucket", H.bucket_for(F.col("molecule_id")))
    ids = x.select("bucket", "molecule_id").distinct().orderBy("bucket", "molecule_id").limit(100)
    return x.join(ids.select("molecule_id"), "molecule_id", "left_semi").groupBy("molecule_id").agg(F.count("*").alias("spectra"))


@query("SELECT round(quantile_cont(l_extendedprice, 0.05), 4) AS q05, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95 FROM lineitem")
def q_quantiles(spark, sf_dir):
    x = quantiles.linear(_table(spark, sf_dir, "lineitem"), [], "l_extendedprice", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    return _rounded(x, x.columns)


@query("SELECT p_name AS name, round(p_retailprice, 4) AS mrr25, p_size AS top1, p_partkey % 50 AS trees FROM part ORDER BY p_retailprice DESC, p_size DESC, p_partkey % 50, p_name LIMIT 1")
def q_select_model(spark, sf_dir):
    x = _table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("mrr25"), F.col("p_size").alias("top1"), (F.col("p_partkey") % 50).alias("trees"))
    return stats.select_model(x).withColumn("mrr25", _r("mrr25", 4))


@query(D + ", s AS (SELECT DISTINCT coalesce(ingest_lib, 'unknown') AS source, molecule_id FROM spec), p AS (SELECT source, count(*)::DOUBLE / (SELECT count(*) FROM s) AS prior FROM s GROUP BY source), w AS (SELECT s.source, s.molecule_id, prior / 100 AS raw FROM s JOIN p USING (source)) SELECT source, molecule_id, round(raw / avg(raw) OVER (), 6) AS weight FROM w")
def q_query_weights(spark, sf_dir):
    x = derived.spectra(spark, sf_dir).select(F.coalesce("ingest_lib", F.lit("unknown")).alias("source"), "molecule_id").distinct()
    asked = x.select("source").distinct().withColumn("requested", F.lit(100.0))
    return stats.query_weights(x, ev.priors(x), asked).select("source", "molecule_id", _r("weight").alias("weight"))


@query(D + ", s AS (SELECT DISTINCT coalesce(ingest_lib, 'unknown') AS source, molecule_id FROM spec), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || source || ':' || molecule_id)) AS k FROM s) SELECT source, molecule_id FROM r WHERE k <= CASE source WHEN 'F' THEN 30 WHEN 'O' THEN 20 ELSE 10 END")
def q_source_sample(spark, sf_dir):
    x = derived.spectra(spark, sf_dir).select(F.coalesce("ingest_lib", F.lit("unknown")).alias("source"), "molecule_id")
    return stats.source_sample(x, {"F": 30, "O": 20, "unknown": 10}, 7)


@query(D + ", g AS (SELECT molecule_id, max(precursor_error_ppm) AS max_ppm, min(precursor_error_ppm) AS min_ppm, avg((base_peak_intensity IS NULL)::INTEGER) AS missing_base, count(DISTINCT instrument_type) AS instruments FROM spec GROUP BY molecule_id) SELECT molecule_id, max_ppm, min_ppm, round(missing_base, 6) AS missing_base, instruments FROM g")
def q_group_diagnostics(spark, sf_dir):
    x = derived.spectra(spark, sf_dir).groupBy("molecule_id").agg(F.max("precursor_error_ppm").alias("max_ppm"), F.min("precursor_error_ppm").alias("min_ppm"), _r(F.avg(F.col("base_peak_intensity").isNull().cast("int"))).alias("missing_base"), F.count_distinct("instrument_type").alias("instruments"))
    return x


@query(D + "SELECT coalesce(ingest_lib, 'unknown') || '::' || molecule_id AS key, molecule_id AS structure, count(*) AS n FROM spec GROUP BY 1, 2")
def q_prefixed_keys(spark, sf_dir):
    x = derived.spectra(spark, sf_dir).withColumn("key", F.concat(F.coalesce("ingest_lib", F.lit("unknown")), F.lit("::"), "molecule_id"))
    return x.groupBy("key", F.split_part("key", F.lit("::"), F.lit(2)).alias("structure")).agg(F.count("*").alias("n"))


# Resampling, order and quantiles
_HASH = f"('0x' || substr(sha256({{}}), 1, 15))::BIGINT % {stats.PRIME}"
_WEIGHT = "CASE " + " ".join(f"WHEN z < {t} THEN {k}" for k, t in enumerate(stats.POISSON)) + f" ELSE {len(stats.POISSON)} END"


@query(_RANKED + f""", v AS (SELECT source, {_HASH.format("g::VARCHAR")} AS h, coalesce(1.0::DOUBLE / rank, 0) AS value FROM x WHERE source IS NOT NULL),
reps AS (SELECT rep, {", ".join(f"{_HASH.format(f"rep || ':{j}'")} AS c{j}" for j in range(4))} FROM generate_series(1, 3000) t(rep)),
z AS (SELECT source, value, rep, (((((c3 * h + c2) % {stats.PRIME}) * h + c1) % {stats.PRIME}) * h + c0) % {stats.PRIME} AS z FROM v, reps),
w AS (SELECT source, rep, value, {_WEIGHT} AS w FROM z),
m AS (SELECT source, rep, sum(w * value) / sum(w) AS m FROM w GROUP BY ALL HAVING sum(w) > 0),
p AS (SELECT source, count(DISTINCT g)::DOUBLE / sum(count(DISTINCT g)) OVER () AS prior FROM x GROUP BY source)
SELECT rep::INTEGER AS rep, round(sum(m * prior), 6) AS mean FROM m JOIN p USING (source) GROUP BY rep""")
def q_poisson_bootstrap(spark, sf_dir):
    x = _truth(spark, sf_dir).withColumn("value", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))
    return _rounded(stats.poisson_bootstrap(x, ev.priors(x), "value"), ["mean"])


_SUMS = "count(*) AS molecules, count(rank) AS found, " + ", ".join(f"count(*) FILTER (WHERE rank <= {k}) AS in{k}" for k in ev.CUTS) + ", coalesce(sum(1.0::DOUBLE / rank) FILTER (WHERE rank <= 25), 0) AS rr25, coalesce(sum(1.0::DOUBLE / rank), 0) AS rr"
_OF_SUMS = "molecules::BIGINT AS molecules, round(found / molecules, 6) AS candidate_recall, " + ", ".join(f"round(in{k} / molecules, 6) AS top{k}" for k in ev.CUTS) + ", round(rr25 / molecules, 6) AS mrr25, round(rr / molecules, 6) AS mrr"


@query(_RANKED + f""", d AS (SELECT g, row_number() OVER (ORDER BY sha256('42:' || g), g) - 1 AS place, (SELECT count(*) // 6 FROM x) AS size FROM x WHERE g % 7 <> 0),
s AS (SELECT place // size + 1 AS batch, {_SUMS} FROM d JOIN x USING (g) WHERE place < 5 * size GROUP BY 1),
c AS (SELECT batch, {", ".join(f"sum({n}) OVER (ORDER BY batch) AS {n}" for n in ev._SUMS)} FROM s)
SELECT 'batch' AS part, batch::INTEGER AS batch, {_OF_SUMS} FROM s UNION ALL SELECT 'cumulative', batch::INTEGER, {_OF_SUMS} FROM c""")
def q_stability(spark, sf_dir):
    """Batches of a sixth of all molecules, those of a first sample left out."""
    x = _truth(spark, sf_dir)
    out = ev.stability(x, "molecule_id", 5, x.count() // 6, 42, used=x.where("molecule_id % 7 = 0"))
    return _rounded(out, [*_MN, "mrr"]).withColumn("molecules", F.col("molecules").cast("long"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY sha256('7:' || o_orderkey), o_orderkey) - 1 AS place, ((row_number() OVER (ORDER BY sha256('7:' || o_orderkey), o_orderkey) - 1) // 300 + 1)::INTEGER AS batch FROM orders")
def q_places(spark, sf_dir):
    x = ranks.numbered(_table(spark, sf_dir, "orders").select("o_orderkey"), *ranks.seeded("o_orderkey", 7))
    return x.select("o_orderkey", "place", (F.floor(F.col("place") / 300) + 1).cast("int").alias("batch"))


@query("SELECT shard, count(*) AS keys, min(k) AS first, max(k) AS last FROM (SELECT k, ((row_number() OVER (ORDER BY k) - 1) // 100)::INTEGER AS shard FROM (SELECT DISTINCT o_custkey AS k FROM orders)) GROUP BY shard")
def q_shards(spark, sf_dir):
    """Written in shards of 100 keys, checked for completeness, merged in order, and read back with the shard that each key was in."""
    x = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    base = f"{tables.shared_folder(spark)}/ionflow/shards-{uuid.uuid4().hex[:12]}"
    files.write_shards(x, f"{base}/shards", "k", 100)
    files.merge_shards(spark, f"{base}/shards", f"{base}/merged", "k", x, 100)
    own = spark.read.parquet(f"{base}/shards").select("k", "shard").distinct()
    merged = spark.read.parquet(f"{base}/merged").select("k").distinct()
    return merged.join(own, "k").groupBy("shard").agg(F.count("*").alias("keys"), F.min("k").alias("first"), F.max("k").alias("last"))


_SHARES = {"q01": 0.01, "q50": 0.5, "q99": 0.99}


@query("WITH v AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_extendedprice - 30000 AS v FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY flag, status ORDER BY v) AS i, count(*) OVER (PARTITION BY flag, status) AS n FROM v) SELECT flag, status, "
    + ", ".join(f"round(max(v) FILTER (WHERE i = round((n - 1) * {q}::DOUBLE) + 1), 4) AS {k}" for k, q in _SHARES.items()) + ", " + ", ".join(f"round(quantile_cont(v, {q}), 4) AS {k}_linear" for k, q in _SHARES.items()) + " FROM o GROUP BY flag, status")
def q_exact_quantiles(spark, sf_dir):
    by = ["flag", "status"]
    x = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_extendedprice") - 30000).alias("v"))
    out = quantiles.nearest(x, by, "v", _SHARES).join(quantiles.linear(x, by, "v", {f"{k}_linear": q for k, q in _SHARES.items()}), by)
    return out.select(*by, *(_r(c, 4).alias(c) for c in out.columns if c not in by))


# Comparisons: the same candidates ranked by quantity and by price
_OTHER = _RANKED + """, r2 AS (SELECT l_orderkey AS g, l_linenumber AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2)),
x2 AS (SELECT t.g, r2.rank FROM t LEFT JOIN r2 ON t.g = r2.g AND t.f = r2.f),
pr AS (SELECT x.g, coalesce(1.0::DOUBLE / x.rank, 0) AS a, coalesce(1.0::DOUBLE / x2.rank, 0) AS b FROM x JOIN x2 USING (g)) """


def _other_truth(spark, sf_dir):
    r = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("molecule_id"), F.col("l_linenumber").alias("formula")).agg(F.max("l_extendedprice").alias("score"))
    return ranking.truth_rank(ranking.by_score(r), _ranked(spark, sf_dir)[1])


def _pairs(spark, sf_dir):
    value = compare.reciprocal().alias("value")
    return compare.paired(*(f(spark, sf_dir).select("molecule_id", value) for f in (_truth, _other_truth)), "molecule_id", "value")


@query(_OTHER + "SELECT count(*) AS pairs, count(*) FILTER (WHERE b > a) AS improved, count(*) FILTER (WHERE b < a) AS worsened, count(*) FILTER (WHERE a = b) AS unchanged, round(avg(b - a), 6) AS mean FROM pr")
def q_model_pairs(spark, sf_dir):
    return _rounded(compare.paired_change(_pairs(spark, sf_dir)), ["mean"])


@query(_OTHER + f""", v AS (SELECT {_HASH.format("g::VARCHAR")} AS h, b - a AS value FROM pr),
reps AS (SELECT rep, {", ".join(f"{_HASH.format(f"rep || ':{j}'")} AS c{j}" for j in range(4))} FROM generate_series(1, 500) t(rep)),
z AS (SELECT value, rep, (((((c3 * h + c2) % {stats.PRIME}) * h + c1) % {stats.PRIME}) * h + c0) % {stats.PRIME} AS z FROM v, reps),
m AS (SELECT rep, sum({_WEIGHT} * value) / sum({_WEIGHT}) AS m FROM z GROUP BY rep)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def q_paired_interval(spark, sf_dir):
    return _rounded(compare.paired_interval(_pairs(spark, sf_dir), "molecule_id", 500), ["low", "high"])


@query("SELECT k, CASE WHEN k IS NULL THEN 'null' WHEN b = 0 THEN 'left_only' WHEN a = 0 THEN 'right_only' ELSE 'repeated' END AS fault FROM (SELECT k, sum(a) AS a, sum(b) AS b FROM (SELECT c_custkey AS k, 1 AS a, 0 AS b FROM customer UNION ALL SELECT o_custkey, 0, 1 FROM orders) GROUP BY k) WHERE k IS NULL OR a <> 1 OR b <> 1")
def q_pair_faults(spark, sf_dir):
    left, right = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return compare.pair_faults(left, right, "k")


@query(D + """, k AS (SELECT s.molecule_id, s.row_ord, s.base_peak_intensity >= 1000 OR s.base_peak_intensity IS NULL AS kept, count(p.row_ord) AS peaks, count(p.row_ord) FILTER (WHERE p.mz <= precursor_mz + 2.0) AS good FROM spec s LEFT JOIN peak p USING (row_ord) GROUP BY ALL),
m AS (SELECT molecule_id, count(*) AS spectra, sum(peaks) AS peaks, count(*) FILTER (WHERE kept) AS spectra2, sum(good) FILTER (WHERE kept) AS peaks2, bool_and(kept AND good = peaks) AS same FROM k GROUP BY molecule_id)
SELECT 'first' AS arm, molecule_id, spectra, peaks::BIGINT AS peaks, false AS reused FROM m UNION ALL SELECT 'second', molecule_id, spectra2, peaks2::BIGINT, same FROM m WHERE spectra2 > 0""")
def q_two_arms(spark, sf_dir):
    """All spectra against those that the lenient rule leaves; molecules that it leaves as they are are not computed again."""
    x = derived.spectra(spark, sf_dir)

    def compute(rows):
        return rows.groupBy("molecule_id").agg(F.count("*").alias("spectra"), F.sum(F.size("ms2_mzs")).alias("peaks"))

    return compare.two_arms(x, S.clean_by_rule(x, keep_unknown_base=True), compute).select("arm", "molecule_id", "spectra", "peaks", "reused")


_COHORT_SQL = {"all": "true", "recalled": "rank IS NOT NULL", "mass_window": "mass BETWEEN 237 AND 465", "within_ppm": "abs(g % 41 - 20) <= 10", "seen": "seen", "unseen": "NOT seen", "single": "f = 1", "multiple": "f > 1"}


@query(_RANKED + " UNION ALL ".join(f"SELECT '{name}' AS cohort, {_M} FROM x WHERE {p} HAVING count(*) > 0" for name, p in _COHORT_SQL.items()))
def q_cohorts(spark, sf_dir):
    x = _truth(spark, sf_dir).withColumn("error_ppm", F.col("molecule_id") % 41 - 20).withColumn("spectra", F.col("formula"))
    return _rounded(compare.cohort_metrics(x, compare.diagnostic_cohorts()))


@query(_RANKED + f""", m AS (SELECT source AS cohort, {_M.replace("round(", "(").replace(", 6)", ")")} FROM x GROUP BY source), l AS (UNPIVOT m ON {", ".join(f"{n}::DOUBLE AS {n}" for n in ("molecules", *_MN))} INTO NAME metric VALUE v)
SELECT cohort, metric, round(CASE WHEN metric <> 'top5' THEN CASE metric WHEN 'top1' THEN v + 0.125 ELSE v END END, 6) AS published, round(v, 6) AS recomputed, CASE metric WHEN 'top1' THEN 'differs' WHEN 'top5' THEN 'unpublished' END AS fault FROM l""")
def q_report_audit(spark, sf_dir):
    """A report by source in which top1 is wrong and top5 is left out, against its records."""
    x = _truth(spark, sf_dir)
    sources = {r.source: F.col("source") == r.source for r in x.select("source").distinct().collect()}
    own = ev.metrics(x, ["source"]).withColumn("top1", F.col("top1") + 0.125)
    names = [n for n in ("molecules", *_MN) if n != "top5"]
    published = own.select(F.col("source").alias("cohort"), F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("double") for n in names)))).alias("metric", "value"))
    return _rounded(compare.recomputed(x, published, sources), ["published", "recomputed"])


# Whole engine: rows only, or held against counts
def _predicted(spark, sf_dir):
    rows = derived.spectra(spark, sf_dir).select("molecule_id", "spectrum_id", *S.INFERENCE_COLUMNS, "row_ord")
    return FormulaEngine(spark).predict(rows, 5)


def _whole(spark, sf_dir, features=feat.of_lists, *more):
    """Molecules with their candidates within the engine's own limits and what features are made of."""
    config = EngineConfig()
    # read by the searches and by each molecule's evidence
    x = tables.materialize(_all(spark, sf_dir, config).drop("ms2_mzs", "ms2_normalized_intensities"), "spectra")
    own, lists, _ = cand.lists(x, config)
    return features(own.select("molecule_id", "like", "deal"), lists, x, config, *more)


@query()
def q_predict(spark, sf_dir):
    x = _predicted(spark, sf_dir)
    return x.select("molecule_id", "status", F.size("candidates").alias("n"), F.try_element_at("candidates", F.lit(1))["formula"].alias("first"), F.array_join("warnings", "; ").alias("warnings"))


@query()
def q_features(spark, sf_dir):
    return _whole(spark, sf_dir, feat.table_of_lists, 6)


@query()
def q_baseline_rank(spark, sf_dir):
    best = ranking.baseline_lists(_whole(spark, sf_dir))
    x = best.select("molecule_id", F.size("ranked").alias("n"), F.posexplode("ranked").alias("at", "c"))
    return x.select("molecule_id", "c.formula", (F.col("at") + 1).alias("rank"), (F.col("n") - F.col("at")).cast("double").alias("score"))


@query()
def q_training_rows(spark, sf_dir):
    config = EngineConfig()
    own, lists, _ = cand.lists(_all(spark, sf_dir, config).select("molecule_id", "spectrum_id", "precursor_mz", "adduct", "shift", "delta"), config)
    truth = derived.spectra(spark, sf_dir).select("molecule_id", F.col("molecular_formula").alias("formula")).distinct().groupBy("molecule_id").agg(F.min("formula").alias("formula"))
    x = ranking.training_lists(own.join(truth.withColumnRenamed("formula", "truth"), "molecule_id"), lists, 42)
    return x.select("molecule_id", "formula", "rank", "label")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_predict(spark, sf_dir)

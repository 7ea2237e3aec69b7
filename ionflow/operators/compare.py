"""Comparisons: pairing by checked keys, two arms of which only what differs is computed twice, cohorts, audits of reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ionflow.operators import evaluate, quantiles, stats
from ionflow.sources.tables import materialize


# Pairing
def _sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How often each key stands on each side: summed before the shuffle, so that a key with any number of rows is one."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def pair_faults(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, fault) of keys that do not pair one to one: left_only, right_only, repeated or null."""
    fault = F.when(F.col(key).isNull(), "null").when(F.col("r") == 0, "left_only").when(F.col("l") == 0, "right_only").when((F.col("l") > 1) | (F.col("r") > 1), "repeated")
    return _sides(left, right, key).withColumn("fault", fault).where("fault is not null").select(key, "fault")


def paired(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta) of two sets of records with the same keys, once each; other keys are an error that counts them.

    Records pair by key, never by place: a record that one side lacks cannot shift the others.
    """
    faults = {r.fault: r["count"] for r in pair_faults(left, right, key).groupBy("fault").count().collect()}
    if faults:
        raise ValueError("records do not pair: " + ", ".join(f"{n} {k}" for k, n in sorted(faults.items())))
    both = left.select(key, F.col(value).alias("before")).join(right.select(key, F.col(value).alias("after")), key)
    return both.withColumn("delta", F.col("after") - F.col("before"))


def reciprocal(rank: str = "rank", cut: int | None = None) -> Column:
    """1 / rank, 0 for none or one beyond cut."""
    r = F.col(rank)
    return F.coalesce(F.when((r <= cut) if cut else r.isNotNull(), 1.0 / r), F.lit(0.0))


def paired_change(pairs: DataFrame) -> DataFrame:
    """pairs, improved, worsened, unchanged and mean delta."""
    d = F.col("delta")
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(d > 0).alias("improved"), F.count_if(d < 0).alias("worsened"), F.count_if(d == 0).alias("unchanged"), F.avg(d).alias("mean"))


def paired_interval(pairs: DataFrame, key: str, reps: int = 3000, level: float = 0.95) -> DataFrame:
    """(low, high): interval of the mean delta, resampled by weights of hashed keys in one pass; no delta is collected."""
    one = pairs.select(F.lit("all").alias("source"), key, "delta")
    priors = pairs.sparkSession.createDataFrame([("all", 1.0)], "source string, prior double")
    means = materialize(stats.poisson_bootstrap(one, priors, "delta", reps, key), "interval")
    return quantiles.linear(means, [], "mean", {"low": (1 - level) / 2, "high": (1 + level) / 2})


# Two arms
_OBSERVED = ("precursor_mz", "adduct", "ms2_mzs", "ms2_normalized_intensities", "collision_energy_ev", "base_peak_intensity", "instrument_type")


def fingerprint() -> Column:
    """SHA-256 of what is observed in a spectrum, as JSON with nulls; its id and mode have no part in it."""
    return F.sha2(F.to_json(F.struct(*_OBSERVED), {"ignoreNullFields": "false"}), 256)


def molecule_marks(rows: DataFrame, order: str = "row_ord") -> DataFrame:
    """(molecule_id, mark): a digest of the molecule's spectra in their order, without their places."""
    one = rows.select("molecule_id", F.struct(F.col(order).alias("o"), fingerprint().alias("f")).alias("s"))
    lines = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["f"])
    return one.groupBy("molecule_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("mark"))


def two_arms(first: DataFrame, second: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """compute of both arms' spectra, with arm (first, second) and reused.

    compute gives rows by molecule_id that depend on the molecule's spectra alone. In
    the second arm it is given only molecules that the first lacks or has with other
    spectra; the rows of others are the first arm's. A molecule that an arm has no
    spectra of has no rows in it.
    """
    done = materialize(compute(first), "arm")
    marks = molecule_marks(second).join(molecule_marks(first).withColumnRenamed("mark", "own"), "molecule_id", "left")
    marks = materialize(marks.select("molecule_id", F.col("mark").eqNullSafe(F.col("own")).alias("same")), "marks")
    fresh = compute(second.join(marks.where("not same"), "molecule_id", "left_semi"))
    copied = done.join(marks.where("same"), "molecule_id", "left_semi")
    out = done.withColumn("arm", F.lit("first")).withColumn("reused", F.lit(False))
    out = out.unionByName(fresh.withColumn("arm", F.lit("second")).withColumn("reused", F.lit(False)))
    return out.unionByName(copied.withColumn("arm", F.lit("second")).withColumn("reused", F.lit(True)))


# Cohorts
def in_cohorts(records: DataFrame, cohorts: dict[str, Column]) -> DataFrame:
    """A row for each cohort that a record is in; a predicate that is null is not met."""
    names = F.array(*(F.when(p, F.lit(name)) for name, p in cohorts.items()))
    return records.withColumn("cohort", F.explode(F.filter(names, lambda n: n.isNotNull())))


def cohort_metrics(records: DataFrame, cohorts: dict[str, Column], rank: str = "rank") -> DataFrame:
    """Metrics of every cohort from one scan; cohorts may overlap, and those without records have none."""
    return evaluate.metrics(in_cohorts(records, cohorts), ["cohort"], rank)


def diagnostic_cohorts(low: float = 237.0, high: float = 465.0, ppm: float = 10.0) -> dict[str, Column]:
    """Cohorts that evaluations report: all, recalled, a window of mass, small errors, seen or not, one spectrum or several."""
    return {
        "all": F.lit(True),
        "recalled": F.col("rank").isNotNull(),
        "mass_window": F.col("neutral_mass").between(low, high),
        "within_ppm": F.abs("error_ppm") <= ppm,
        "seen": F.col("seen"),
        "unseen": ~F.col("seen"),
        "single": F.col("spectra") == 1,
        "multiple": F.col("spectra") > 1,
    }


def from_source(source: str, instrument: str | None = None) -> Column:
    """Rows of a source, of one instrument if given."""
    own = F.col("ingest_lib") == source
    return own if instrument is None else own & (F.col("instrument_type") == instrument)


# Audits
def recomputed(records: DataFrame, published: DataFrame, cohorts: dict[str, Column], rank: str = "rank", within: float = 1e-12) -> DataFrame:
    """(cohort, metric, published, recomputed, fault): metrics that were published against those of the stored records.

    published: cohort, metric, value. fault: missing (no such cohort or metric can
    be made), differs, or unpublished (made, but not published); null: well.
    """
    own = cohort_metrics(records, cohorts, rank)
    names = [c for c in own.columns if c != "cohort"]
    long = own.select("cohort", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c).cast("double") for c in names)))).alias("metric", "recomputed"))
    both = published.select("cohort", "metric", F.col("value").cast("double").alias("published"), F.lit(True).alias("p")).join(long.withColumn("r", F.lit(True)), ["cohort", "metric"], "full")
    fault = F.when(F.col("r").isNull(), "missing").when(F.col("p").isNull(), "unpublished").when(~F.coalesce(F.abs(F.col("published") - F.col("recomputed")) <= within, F.lit(False)), "differs")
    return both.select("cohort", "metric", "published", "recomputed", fault.alias("fault"))


def split_overlap(rows: DataFrame, key: str = "molecule_id") -> DataFrame:
    """(key, splits) of structures in more than one split; none is well."""
    by = rows.select(key, "split").distinct().groupBy(key).agg(F.count("*").alias("splits"))
    return by.where("splits > 1")

"""Ranking metrics, strata, ablations, training and evaluation runs, and checks of written results."""

from __future__ import annotations

import json
import os
import resource

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ionflow.config import EngineConfig
from ionflow.functions import chemistry as C
from ionflow.operators import cache, features as feat, ranking, ranks
from ionflow.sources import files, tables

CUTS = (1, 5, 10, 25)


def metric_columns(rank: str = "rank") -> list[Column]:
    """n, recall, top-k shares and MRR@25 of a group; null ranks count as misses, no rows give 0."""
    r = F.col(rank)
    out = [F.count("*").alias("molecules"), F.coalesce(F.avg(r.isNotNull().cast("double")), F.lit(0.0)).alias("candidate_recall")]
    out += [F.coalesce(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"top{k}") for k in CUTS]
    return [*out, F.coalesce(F.avg(F.when(r <= 25, 1.0 / r).otherwise(0.0)), F.lit(0.0)).alias("mrr25")]


def metrics(rows: DataFrame, by: list[str] = [], rank: str = "rank") -> DataFrame:
    return rows.groupBy(*by).agg(*metric_columns(rank)) if by else rows.agg(*metric_columns(rank))


def metric_sums(rows: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """What metrics are made of, as sums by group that can be added up: they merge over batches, shards and reruns."""
    r = F.col(rank)
    sums = [F.count("*").alias("molecules"), F.count(r).alias("found"), *(F.count_if(r <= k).alias(f"in{k}") for k in CUTS)]
    return rows.groupBy(*by).agg(*sums, F.coalesce(F.sum(F.when(r <= 25, 1.0 / r)), F.lit(0.0)).alias("rr25"), F.coalesce(F.sum(1.0 / r), F.lit(0.0)).alias("rr"))


_SUMS = ("molecules", "found", *(f"in{k}" for k in CUTS), "rr25", "rr")


def merged_sums(sums: DataFrame, by: list[str] = []) -> DataFrame:
    return sums.groupBy(*by).agg(*(F.sum(c).alias(c) for c in _SUMS))


def cumulative_sums(sums: DataFrame, order: str) -> DataFrame:
    """Sums of each batch and all before it (a row a batch)."""
    upto = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return sums.select(order, *(F.sum(c).over(upto).alias(c) for c in _SUMS))


def metrics_of(sums: DataFrame) -> DataFrame:
    """Metrics of sums, with full MRR; no molecules give 0."""
    n = F.greatest("molecules", F.lit(1))
    others = [c for c in sums.columns if c not in _SUMS]
    shares = {"candidate_recall": "found", **{f"top{k}": f"in{k}" for k in CUTS}, "mrr25": "rr25", "mrr": "rr"}
    return sums.select(*others, "molecules", *((F.col(c) / n).alias(name) for name, c in shares.items()))


def stability(records: DataFrame, key: str, batches: int, size: int, seed: int, used: DataFrame | None = None) -> DataFrame:
    """Metrics of disjoint batches of records drawn by seed, and of all batches up to each: batch, part, metrics.

    Records whose keys are used already, in a sample that settings were chosen by
    say, are left out. Too few records for the batches are an error.
    """
    population = records.select(key)
    drawn = ranks.fresh_sample(population, population.limit(0) if used is None else used, key, batches * size, seed)
    drawn = tables.materialize(drawn.withColumn("batch", (F.floor(F.col("place") / size) + 1).cast("int")).drop("place"), "stability")
    if (n := drawn.count()) < batches * size:
        raise ValueError(f"{n} unused records are too few for {batches} batches of {size}")
    sums = tables.materialize(metric_sums(records.join(drawn, key), ["batch"]), "stability")
    own = metrics_of(sums).withColumn("part", F.lit("batch"))
    return own.unionByName(metrics_of(cumulative_sums(sums, "batch")).withColumn("part", F.lit("cumulative")))


def mass_bin(mass: Column) -> Column:
    return F.when(mass < 300, "<300").when(mass < 600, "300-600").otherwise(">=600")


def strata(records: DataFrame) -> DataFrame:
    """A row for each stratum of a molecule: modes, sources, mass and whether its formula was seen."""
    tags = F.concat(
        F.transform("modes", lambda m: F.concat(F.lit("mode:"), m)),
        F.transform("sources", lambda s: F.concat(F.lit("source:"), s)),
        F.array(F.concat(F.lit("mass:"), mass_bin(F.col("neutral_mass"))), F.when(F.col("seen"), "formula:seen").otherwise("formula:unseen")),
    )
    return records.withColumn("stratum", F.explode(tags))


def stratified(records: DataFrame) -> DataFrame:
    return metrics(strata(records), ["stratum"])


def weighted(records: DataFrame, priors: DataFrame) -> DataFrame:
    """Metrics by source, summed by prior, and the plain average over all."""
    by = metrics(records, ["source"]).join(F.broadcast(priors), "source")
    names = ["candidate_recall", *(f"top{k}" for k in CUTS), "mrr25"]
    mean = by.agg(*(F.sum(F.col(n) * F.col("prior")).alias(n) for n in names)).withColumn("average", F.lit("weighted"))
    return mean.unionByName(metrics(records).select(*names).withColumn("average", F.lit("micro")))


def priors(rows: DataFrame, key: str = "molecule_id") -> DataFrame:
    """Each source's share of structures."""
    by = rows.groupBy("source").agg(F.count_distinct(key).alias("structures"))
    return by.withColumn("prior", F.col("structures") / F.sum("structures").over(W.partitionBy()))


def rates(records: DataFrame) -> DataFrame:
    names = (("no_candidates", "no_candidate_rate"), ("truncated", "truncation_rate"), ("resource_limited", "resource_limit_rate"))
    return records.agg(*(F.coalesce(F.avg(F.col(a).cast("double")), F.lit(0.0)).alias(b) for a, b in names))


def groups_of(rows: DataFrame) -> DataFrame:
    """Truth and sources of each molecule of a prepared split."""
    return rows.groupBy("molecule_id").agg(F.min("molecular_formula").alias("formula"), F.array_sort(F.collect_set("ingest_lib")).alias("sources"))


def records(engine, rows: DataFrame, seen: DataFrame, ablations: bool = True) -> DataFrame:
    """One record a molecule: ranks of the truth by each order, flags, and what strata need."""
    x, spectra, failed = engine.candidate_features(rows)
    truth = groups_of(rows)
    first = spectra.groupBy("molecule_id").agg(F.min_by(C.neutral_mass(F.col("precursor_mz"), F.col("shift")), "row_ord").alias("neutral_mass"), F.array_sort(F.collect_set(F.when(F.col("charge") > 0, "positive").otherwise("negative"))).alias("modes"))

    def ranks(ranked: DataFrame, name: str) -> DataFrame:
        return ranking.truth_rank(ranked, truth.select("molecule_id", "formula")).select("molecule_id", F.col("rank").alias(name))

    out = truth.join(first, "molecule_id", "left").join(seen.select("formula", F.lit(True).alias("seen")).distinct(), "formula", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    out = out.join(ranks(engine.ranked(x), "rank"), "molecule_id").join(ranks(ranking.baseline(x), "baseline_rank"), "molecule_id").join(ranks(ranking.mass_only(x), "mass_only_rank"), "molecule_id")
    if ablations:
        one = rows.withColumn("__k", F.row_number().over(W.partitionBy("molecule_id").orderBy("row_ord"))).where("__k = 1").drop("__k")
        single, _, _ = engine.candidate_features(one)
        out = out.join(ranks(ranking.baseline(single), "single_spectrum_rank"), "molecule_id")
    n = x.groupBy("molecule_id").agg(F.max("total").alias("total"))
    out = out.join(n, "molecule_id", "left").join(failed.select("molecule_id", "status"), "molecule_id", "left")
    return out.withColumns({
        "truncated": F.coalesce(F.col("total") > engine.config.max_candidates, F.lit(False)),
        "no_candidates": F.col("total").isNull(),
        "resource_limited": F.coalesce(F.col("status") == "resource_limit", F.lit(False)),
    }).drop("total", "status")


def evaluate(engine, prepared: str, split: str = "test", max_molecules: int | None = None, ablations: bool = True, seen: list[str] | None = None) -> dict:
    spark = engine.spark
    rows = files.read_split(spark, prepared, split, max_molecules)
    if seen is None:
        seen = files.read_json(f"{prepared}/train_formulas.json")
    known = spark.createDataFrame([(f,) for f in seen] or [("",)], "formula string")
    rec = tables.materialize(records(engine, rows, known, ablations), "records")
    names = ["mass_only_rank", "baseline_rank", *(["single_spectrum_rank"] if ablations else [])]
    return {
        **metrics(rec).first().asDict(),
        "split": split,
        "max_molecules": max_molecules,
        **rates(rec).first().asDict(),
        "strata": {r.stratum: {k: v for k, v in r.asDict().items() if k != "stratum"} for r in stratified(rec).collect()},
        "ablations": {n: metrics(rec, rank=n).first().asDict() for n in names},
        "peak_rss_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024,
    }


def feature_cache(engine, rows: DataFrame, root: str, training: bool, identity: dict, told=None) -> DataFrame:
    """Ranked candidates with features of a split, computed bucket by bucket and kept under root.

    identity: what the rows are of (data, split, limit); settings and feature names
    are added. A run that was stopped goes on with the buckets that are not done.
    """

    def compute(part: DataFrame) -> DataFrame:
        x, _, _ = engine.candidate_features(part)
        ranked, truth = ranking.baseline(x), groups_of(part)
        if training:
            out = ranking.training_rows(ranked, truth, engine.config.seed)
        else:
            out = ranked.join(truth.select("molecule_id", F.col("formula").alias("truth")), "molecule_id").withColumn("label", (F.col("formula") == F.col("truth")).cast("int")).drop("truth")
        out = out.select("molecule_id", "formula", "label", *(F.col(c).cast("float").alias(c) for c in feat.FEATURES))
        return out.join(part.select("molecule_id", "bucket").distinct(), "molecule_id")

    own = {"config": engine.config.to_dict(), "features": list(feat.FEATURES), "training": training}
    return cache.UnitCache(engine.spark, root, identity | own).fill(rows, compute, told=told).drop("bucket")


def _matrix(cache: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pdf = cache.orderBy("molecule_id", "formula").toPandas()
    return pdf[feat.FEATURES].to_numpy(np.float32), pdf["label"].to_numpy(), pdf.groupby("molecule_id", sort=True).size().to_numpy()


def train(spark: SparkSession, prepared: str, output: str, train_molecules: int = 3000, validation_molecules: int = 500, rounds: int = 1000, cache_root: str | None = None) -> dict:
    """Fit a ranker on so many molecules of the prepared train split; candidates of each are at most 256 rows.

    Features are kept beside output (or under cache_root): a run that was stopped
    before the model was written goes on where it was, and so does one with other
    rounds; other data, settings, splits or numbers of molecules start anew.
    """
    from ionflow.engine import FormulaEngine

    files.require_new_dir(output)
    config = EngineConfig.load(f"{prepared}/config.json")
    engine = FormulaEngine(spark, config)
    data = files.read_json(f"{prepared}/manifest.json")["file_fingerprint"]
    sets, formulas, counts = [], [], []
    for split, n in (("train", train_molecules), ("validation", validation_molecules)):
        rows = files.read_split(spark, prepared, split, n)
        done = feature_cache(engine, rows, cache_root or f"{output.rstrip('/')}-cache", split == "train", {"data": data, "split": split, "molecules": n})
        sets.append(_matrix(done))
        counts.append(rows.select("molecule_id").distinct().count())
        if split == "train":
            formulas = sorted(r[0] for r in done.where("label = 1").select("formula").distinct().collect())
    x, y, sizes = sets[0]
    model = ranking.fit(x, y, sizes, valid=sets[1] if len(sets[1][0]) else None, rounds=rounds, valid_groups=counts[1])
    base = metrics(_baseline_ranks(engine, prepared, validation_molecules)).first()["mrr25"]
    text = json.dumps(model.to_dict())
    os.makedirs(output, exist_ok=True)
    with open(f"{output}/model.json", "w", encoding="utf-8") as f:
        f.write(text)
    learned = model.meta["validation_mrr25"]
    meta = {
        "config": config.to_dict(), "config_version": config.version, "fitted_formulas": formulas, "train_molecules": counts[0],
        "validation_molecules": counts[1], "groups": len(sizes), "trees": len(model.trees), "validation_mrr25": learned, "baseline_mrr25": base,
        "recommended": "learned" if learned > base else "baseline", "top_features": ranking.importance(model)[:15],
    }
    files.write_json(f"{output}/metadata.json", meta)
    return meta


def _baseline_ranks(engine, prepared: str, n: int) -> DataFrame:
    rows = files.read_split(engine.spark, prepared, "validation", n)
    x, _, _ = engine.candidate_features(rows)
    return ranking.truth_rank(ranking.baseline(x), groups_of(rows).select("molecule_id", "formula"))


def validate(predictions: DataFrame, ids: DataFrame, config_version: str) -> dict[str, int]:
    """How many predictions break each rule; all 0 is well."""
    item = predictions.select("molecule_id", F.explode("candidates").alias("c"))
    by = item.groupBy("molecule_id").agg(F.count("*").alias("n"), F.max("c.rank").alias("top"), F.count_distinct("c.rank").alias("ranks"), F.count_distinct("c.formula").alias("formulas"), F.min("c.supporting_spectra").alias("least"))
    return {
        "missing_molecules": ids.select("molecule_id").distinct().join(predictions, "molecule_id", "left_anti").count(),
        "unknown_molecules": predictions.join(ids, "molecule_id", "left_anti").count(),
        "broken_ranks": by.where("top <> n or ranks <> n").count(),
        "repeated_formulas": by.where("formulas <> n").count(),
        "unsupported": by.where("least < 1").count(),
        "other_config": predictions.where(F.col("config_version") != config_version).count(),
    }

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionflow import cli
from ionflow.config import EngineConfig
from ionflow.constants import ADDUCTS, shift
from ionflow.engine import FormulaEngine
from ionflow.functions import chemistry as C, hashing as H
from ionflow.operators import evaluate as ev, quality as Q, ranking, stats
from ionflow.sources import files

RAW = "inchikey14 string, molecular_formula string, ingest_lib string, precursor_mz double, adduct string, ionization_mode string, ms2_mzs array<double>, ms2_normalized_intensities array<double>, precursor_error_ppm double, collision_energy_ev array<double>, base_peak_intensity double, instrument_type string"


def raw_row(key, formula="C6H12O6", mz=181.07066456, adduct="[M+H]+", source="a"):
    return (key, formula, source, mz, adduct, "positive", [163.06009988, 145.0495352], [1.0, 0.4], 0.1, None, None, None)


def train_key():
    from hashlib import sha256

    return next(k for k in (f"K{i}" for i in range(100)) if int(sha256(f"42:{k}".encode()).hexdigest()[:16], 16) / 2**64 < 0.8)


def test_prepare(spark, tmp_path):
    rows = [raw_row(train_key()), raw_row("conflict"), raw_row("conflict", "C5H10O5"), raw_row("charged", "C6H12O6+"), raw_row("far", mz=190.0), raw_row("adduct", adduct="[2M+H]+")]
    spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(str(tmp_path / "raw"))
    report = Q.prepare(spark, str(tmp_path / "raw"), str(tmp_path / "out"), EngineConfig())
    assert (report["input_rows"], report["conflicting_structures"], report["accepted_spectra"]) == (6, 1, 1)
    assert {e: report["element_limits"][e] for e in "CHN"} == {"C": 8, "H": 15, "N": 0}
    assert report["rejected"] == {"conflicting_structure": 2, "unsupported_formula": 1, "precursor_error_gt20ppm": 1, "unsupported_adduct": 1}
    with pytest.raises(ValueError):
        Q.prepare(spark, str(tmp_path / "raw"), str(tmp_path / "out"), EngineConfig())
    audit = Q.audit(files.with_row_index(spark, str(tmp_path / "raw")).drop("row_ord"))
    assert audit["rows"] == 6 and audit["conflicting_structures"] == 1 and audit["supported_formula_spectra"] == 5


def test_metrics(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,), (30,)], "rank int")
    m = ev.metrics(rows).first()
    assert (m.top1, m.top5, m.mrr25, m.candidate_recall) == (0.25, 0.5, 0.375, 0.75)
    assert ev.metrics(rows.limit(0)).first().mrr25 == 0.0


def test_target_rank_ties(spark):
    rows = spark.createDataFrame([("a", 2.0, 0, 0), ("a", 2.0, 1, 1), ("a", 1.0, 0, 2), ("b", 0.0, 0, 0), ("b", 3.0, 1, 1)], "g string, s double, y int, o int")
    assert {r.g: r["rank"] for r in ranking.rank_of_target(rows, "g", "s", "y", "o").collect()} == {"a": 2, "b": 1}


def test_hashing(spark):
    from hashlib import sha256

    keys = [f"k{i}" for i in range(500)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", H.unit_interval(F.col("k"), 42).alias("u"), H.bucket_for(F.col("k")).alias("b")).collect()
    for r in got:
        assert r.u == int.from_bytes(sha256(f"42:{r.k}".encode()).digest()[:8], "big") / 2**64
        assert r.b == int.from_bytes(sha256(r.k.encode()).digest()[:4], "big") % 32


def test_nearest_quantile(spark):
    assert spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "x double").agg(Q.nearest_quantile(F.col("x"), 0.99)).first()[0] == 10.0


def test_allocation_and_bootstrap(spark):
    quota = stats.allocate({"a": 100, "b": 10, "c": 3}, {"a": 0.8, "b": 0.15, "c": 0.05}, 50, 5)
    assert sum(quota.values()) == 50 and quota["c"] == 3 and quota["b"] >= 5
    low, high = stats.bootstrap(np.r_[np.zeros(50), np.ones(50)])
    assert 0.38 < low < 0.5 < high < 0.62
    x = spark.range(200).select(F.col("id").cast("string").alias("molecule_id"), F.lit("s").alias("source"), (F.col("id") % 2).cast("double").alias("v"))
    means = [r["mean"] for r in stats.poisson_bootstrap(x, ev.priors(x), "v", reps=40).collect()]
    assert len(means) == 40 and abs(np.mean(means) - 0.5) < 0.05 and 0.01 < np.std(means) < 0.1


def test_allocation_gives_each_unit_to_the_largest_deficit():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = {f"s{k}": int(rng.integers(0, 40)) for k in range(rng.integers(1, 5))}
        w = rng.integers(0, 4, len(n)) + 1e-9
        prior = dict(zip(n, (w / w.sum()).tolist()))
        low = {s: min(3, k) for s, k in n.items()}
        budget = int(rng.integers(sum(low.values()), sum(n.values()) + 1))
        units = sorted(((budget * prior[s] - k, s) for s in n for k in range(low[s], n[s])), reverse=True)[: budget - sum(low.values())]
        assert stats.allocate(n, prior, budget, 3) == {s: low[s] + sum(u[1] == s for u in units) for s in n}


def test_rows_of_several_files_are_numbered(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10, 1, 1).withColumnRenamed("id", "precursor_mz").write.mode("append").parquet(f"{tmp_path}/part-{k}")
    at = files.numbered(spark.read.parquet(*(f"{tmp_path}/part-{k}" for k in range(3))))
    assert sorted((r.row_ord, r.precursor_mz) for r in at.collect()) == [(k, k) for k in range(30)]
    assert files.mark(str(tmp_path)) != files.mark(f"{tmp_path}/part-1")


def test_shards_hold_consecutive_keys(spark, tmp_path):
    rows = spark.range(95).selectExpr("lpad(id, 3, '0') as k", "id")
    files.write_shards(rows, f"{tmp_path}/s", "k", 10)
    got = spark.read.parquet(f"{tmp_path}/s").groupBy("shard").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).collect()
    assert {(r.shard, r.a, r.b, r.n) for r in got} == {(k, 10 * k, min(10 * k + 9, 94), min(10, 95 - 10 * k)) for k in range(10)}


def test_lambdamart_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60 * 20, 3))
    y = np.zeros(len(x))
    for g in range(60):
        y[g * 20 + np.argmax(x[g * 20 : g * 20 + 20, 1])] = 1
    sizes = np.full(60, 20)
    model = ranking.fit(x[:800], y[:800], sizes[:40], valid=(x[800:], y[800:], sizes[40:]), rounds=60)
    assert ranking.mrr(model.predict(x[800:]), y[800:], sizes[40:]) > 0.8
    again = ranking.Ranker.from_dict(model.to_dict())
    assert np.array_equal(again.predict(x), model.predict(x))


def test_train_evaluate_cli(spark, tmp_path):
    rows, k = [], 0
    for i in range(60):
        formula = ("C6H12O6", "C5H10O5")[i % 2]
        rows.append(raw_row(f"T{i}", formula, C.mass_of(C.parse(formula)) + shift(ADDUCTS[0][1], 1)))
    spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(str(tmp_path / "raw"))
    config = EngineConfig(precursor_ppm=1000.0)
    Q.prepare(spark, str(tmp_path / "raw"), str(tmp_path / "p"), config, buckets=2)
    meta = ev.train(spark, str(tmp_path / "p"), str(tmp_path / "m"), 20, 5, rounds=5)
    assert meta["groups"] > 0
    engine = FormulaEngine.load(spark, str(tmp_path / "m"))
    report = ev.evaluate(engine, str(tmp_path / "p"), "validation", 4, ablations=False)
    assert report["molecules"] > 0 and report["candidate_recall"] == 1.0
    with pytest.raises(ValueError):
        FormulaEngine.load(spark, str(tmp_path / "m"), EngineConfig())
    rows = files.read_split(spark, str(tmp_path / "p"), "validation")
    out = engine.predict(rows.select("molecule_id", "spectrum_id", "precursor_mz", "adduct", "ms2_mzs", "ms2_normalized_intensities", "row_ord"))
    assert set(ev.validate(out, rows, engine.config.version).values()) == {0}


def test_cli_errors(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"typo": 1}')
    assert cli.run(["predict", "x", "--output", "y", "--config", str(tmp_path / "c.json")]) == 2
    (tmp_path / "d.json").write_text("{}")
    assert cli.run(["predict", str(tmp_path / "d.json"), "--output", str(tmp_path / "d.json")]) == 2

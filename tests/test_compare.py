"""Pairing, two arms, cohorts, audits, importance and packed trees, against plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionflow.operators import compare, evaluate as ev, ranking
from ionflow.operators.features import FEATURES

SPECTRA = "molecule_id string, row_ord long, precursor_mz double, adduct string, ms2_mzs array<double>, ms2_normalized_intensities array<double>, collision_energy_ev array<double>, base_peak_intensity double, instrument_type string, spectrum_id string, ionization_mode string"


def test_pairs_are_checked(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 30)], "k string, rank int")
    right = spark.createDataFrame([("d", 1), ("c", 4), ("a", 1), ("b", 3)], "k string, rank int")
    one, two = (x.withColumn("v", compare.reciprocal(cut=25)) for x in (left, right))
    pairs = compare.paired(one, two, "k", "v")
    assert {r.k: r.delta for r in pairs.collect()} == {"a": 0.0, "b": pytest.approx(1 / 3 - 1 / 2), "c": 0.25, "d": 1.0}
    r = compare.paired_change(pairs).first()
    assert (r.pairs, r.improved, r.worsened, r.unchanged) == (4, 2, 1, 1)
    odd = two.where("k <> 'b'").union(spark.sql("select 'e', 1, 1.0D")).union(two.where("k = 'a'")).union(spark.sql("select null, 1, 1.0D"))
    assert {(r.k, r.fault) for r in compare.pair_faults(one, odd, "k").collect()} == {("b", "left_only"), ("e", "right_only"), ("a", "repeated"), (None, "null")}
    with pytest.raises(ValueError, match="1 left_only, 1 null, 1 repeated, 1 right_only"):
        compare.paired(one, odd, "k", "v")
    assert compare.paired(one.limit(0), two.limit(0), "k", "v").count() == 0


def test_interval_of_paired_differences(spark):
    x = spark.range(400).selectExpr("concat('m', id) as k", "if(id % 4 = 0, 1.0D, 0.0D) as delta")
    r = compare.paired_interval(x, "k", reps=600).first()
    sd = (0.25 * 0.75 / 400) ** 0.5
    assert abs(r.low - (0.25 - 1.96 * sd)) < 0.4 * sd and abs(r.high - (0.25 + 1.96 * sd)) < 0.4 * sd
    again = compare.paired_interval(x.repartition(7), "k", reps=600).first()
    assert (again.low, again.high) == pytest.approx((r.low, r.high), abs=1e-12)


def _spectrum(m, k, mz=100.0, peaks=(50.0, 60.0), base=2000.0, **more):
    row = dict(molecule_id=m, row_ord=k, precursor_mz=mz, adduct="[M+H]+", ms2_mzs=list(peaks), ms2_normalized_intensities=[1.0] * len(peaks), collision_energy_ev=None, base_peak_intensity=base, instrument_type=None, spectrum_id=f"s{k}", ionization_mode=None)
    return tuple((row | more).values())


def test_only_changed_molecules_are_computed_again(spark):
    first = [_spectrum("same", 1), _spectrum("same", 2, base=None), _spectrum("peaks", 3), _spectrum("gone", 4), _spectrum("fewer", 5), _spectrum("fewer", 6), _spectrum("named", 7), _spectrum("swapped", 8, 1.0), _spectrum("swapped", 9, 2.0)]
    second = [_spectrum("same", 11), _spectrum("same", 12, base=None), _spectrum("peaks", 3, peaks=(50.0,)), _spectrum("fewer", 6), _spectrum("named", 7, spectrum_id="other", ionization_mode="positive"), _spectrum("swapped", 8, 2.0), _spectrum("swapped", 9, 1.0), _spectrum("new", 20)]
    asked = []

    def compute(rows):
        asked.append(sorted({r[0] for r in rows.select("molecule_id").collect()}))
        return rows.groupBy("molecule_id").agg(F.count("*").alias("n"), F.sum(F.size("ms2_mzs")).alias("peaks"))

    out = compare.two_arms(spark.createDataFrame(first, SPECTRA), spark.createDataFrame(second, SPECTRA), compute)
    got = {(r.arm, r.molecule_id): (r.n, r.peaks, r.reused) for r in out.collect()}
    assert asked == [["fewer", "gone", "named", "peaks", "same", "swapped"], ["fewer", "new", "peaks", "swapped"]]
    assert {m: v for (arm, m), v in got.items() if arm == "second"} == {"same": (2, 4, True), "named": (1, 2, True), "peaks": (1, 1, False), "fewer": (1, 2, False), "swapped": (2, 4, False), "new": (1, 2, False)}
    assert {m for arm, m in got if arm == "first"} == {"same", "peaks", "gone", "fewer", "named", "swapped"}


def test_cohorts_and_audit(spark):
    rows = [("a", 1, 240.0, 3.0, True, 1), ("a", 4, 900.0, -3.0, False, 2), ("b", None, 300.0, None, None, 1), ("b", 30, 100.0, 20.0, True, 3)]
    x = spark.createDataFrame(rows, "source string, rank int, neutral_mass double, error_ppm double, seen boolean, spectra int")
    got = {r.cohort: r.molecules for r in compare.cohort_metrics(x, compare.diagnostic_cohorts()).collect()}
    assert got == {"all": 4, "recalled": 3, "mass_window": 2, "within_ppm": 2, "seen": 2, "unseen": 1, "single": 2, "multiple": 2}
    cohorts = {"a": F.col("source") == "a", "none": F.col("source") == "c"}
    assert [r.cohort for r in compare.cohort_metrics(x, cohorts).collect()] == ["a"]
    rows = spark.createDataFrame([("e", "t", 1), ("e", "q", 2), (None, "t", 3), ("f", "t", 4)], "ingest_lib string, instrument_type string, k int")
    assert [r.k for r in rows.where(compare.from_source("e", "t")).collect()] == [1] and rows.where(compare.from_source("e")).count() == 2 and [r.k for r in rows.where(~compare.from_source("e")).collect()] == [4]
    truth = ev.metrics(x.where("source = 'a'")).first().asDict()
    lines = [("a", k, float(v)) for k, v in truth.items() if k != "top25"]
    lines = [(c, k, v + 1e-11 if k == "top1" else v) for c, k, v in lines] + [("z", "top1", 0.5), ("a", "other", 1.0)]
    out = compare.recomputed(x, spark.createDataFrame(lines, "cohort string, metric string, value double"), cohorts)
    assert {(r.cohort, r.metric): r.fault for r in out.where("fault is not null").collect()} == {("a", "top1"): "differs", ("a", "top25"): "unpublished", ("z", "top1"): "missing", ("a", "other"): "missing"}
    splits = spark.createDataFrame([("m", "train"), ("m", "train"), ("n", "train"), ("n", "test")], "molecule_id string, split string")
    assert [tuple(r) for r in compare.split_overlap(splits).collect()] == [("n", 2)]


def test_importance_by_gain_and_packed_trees(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40 * 20, len(FEATURES))).round(3)
    y = np.zeros(len(x))
    for g in range(40):
        y[g * 20 + np.argmax(x[g * 20 : g * 20 + 20, 7])] = 1
    model = ranking.fit(x, y, np.full(40, 20), rounds=25)
    top = ranking.importance(model)
    assert top[0][0] == FEATURES[7] and top[0][1] > 3 * top[1][1] and len(top) == len(FEATURES)
    assert sum(n for _, n in ranking.importance(model, "splits")) == sum((t.feature >= 0).sum() for t in model.trees)
    for t in model.trees:
        inner = np.flatnonzero(t.feature >= 0)
        assert t.cover[0] == len(x) and (t.cover[inner] == t.cover[t.left[inner]] + t.cover[t.right[inner]]).all() and (t.gain[inner] > 0).all()
    again = ranking.Ranker.from_dict(json.loads(json.dumps(model.to_dict())))
    for m in (model, again):
        assert np.array_equal(ranking.Packed(m).predict(x, 64), model.predict(x))
    old = model.to_dict()
    for t in old["trees"]:
        del t["gain"], t["cover"]
    assert np.array_equal(ranking.Ranker.from_dict(old).predict(x), model.predict(x))
    assert ranking.Packed(ranking.Ranker([], 0.1)).predict(x).tolist() == [0.0] * len(x)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{f} double" for f in FEATURES)).repartition(3)
    got = {tuple(r[:-1]): r[-1] for r in ranking.scored(df, model).collect()}
    assert all(got[tuple(map(float, r))] == s for r, s in zip(x[:50], model.predict(x[:50])))

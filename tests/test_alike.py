"""Molecules with the same precursors share one search, and equal ions one search of each peak; results stay those of each alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionflow.config import EngineConfig
from ionflow.operators import candidates as cand, features as feat, kernel, ranking, spectra as S
from ionflow.sources import files

CONFIG = EngineConfig(element_limits={"C": 10, "H": 24, "N": 2, "O": 8})
GLUCOSE = {"precursor_mz": 181.07066456, "adduct": "[M+H]+"}
PEAKS = {"x": [163.06009988, 145.0495352], "y": [163.06009988, 85.0284], "z": [127.0389]}


@pytest.fixture(scope="module")
def spectra(spark):
    rows = None
    for k, (name, mzs) in enumerate(PEAKS.items()):
        x = files.from_mappings(spark, [GLUCOSE | {"spectrum_id": name + "1", "ms2_mzs": mzs, "ms2_normalized_intensities": [1.0, 0.4][: len(mzs)]}, GLUCOSE | {"spectrum_id": name + "2", "adduct": "[M+Na]+", "precursor_mz": 203.0526 + (k == 2) * 0.0001, "ms2_mzs": mzs[:1], "ms2_normalized_intensities": [1.0]}], name)
        rows = x if rows is None else rows.unionByName(x)
    return S.normalize(rows, CONFIG)


def test_alike_molecules_are_searched_once(spectra):
    own, lists, over = cand.lists(spectra, CONFIG)
    assert {r.molecule_id: r.like for r in own.collect()} == {"x": "x", "y": "x", "z": "z"}
    assert sorted(r.like for r in lists.collect()) == ["x", "z"] and over.count() == 0
    for r in cand.candidates(spectra, CONFIG)[0].collect():
        assert set(r.mass_errors_ppm) == {r.molecule_id + "1", r.molecule_id + "2"}


def test_evidence_of_equal_ions(spectra, monkeypatch):
    ions = np.array([[6, 13, 0, 6, 0, 0, 0, 0, 0, 0, 0, 0], [9, 9, 0, 4, 0, 0, 0, 0, 0, 0, 0, 0]])
    searched, inner = [], kernel.Fragments._search
    monkeypatch.setattr(kernel.Fragments, "_search", lambda self, mz: searched.append(mz) or inner(self, mz))
    for _ in range(3):
        x, over = kernel.fragments(ions, 1, 0.002, 10, 250_000).evidence(np.array([31.01839, 145.0495352, 145.0495352]), np.array([0.2, 0.3, 0.7]), np.array([2, 0, 1]))
    assert sorted(searched) == [31.01839, 145.0495352] and not over.any()
    for row, mzs, power in ((0, [31.01839, 145.0495352], [0.2, 0.3]), (1, [], []), (2, [145.0495352], [0.7])):
        assert x[row] == pytest.approx(kernel.fragment_evidence(ions, np.array(mzs), np.array(power), 1, 0.002, 10, 250_000))
    assert kernel.Fragments(ions, 1, 1.0, 10, 1).evidence(np.array([100.0]), np.array([1.0]), np.array([1]))[1].all()


def test_features_and_ranks_are_those_of_each_molecule_alone(spectra):
    own, lists, _ = cand.lists(spectra, CONFIG)
    molecules = feat.of_lists(own.select("molecule_id", "like", "deal"), lists, spectra, CONFIG)
    got = {(r.molecule_id, r.formula): [r[n] for n in feat.FEATURES] for r in feat.rows_of(molecules).collect()}
    alone, ranked = {}, {}
    for name in PEAKS:
        one = spectra.where(F.col("molecule_id") == name)
        x = feat.extract(cand.candidates(one, CONFIG)[0], one, CONFIG)
        alone |= {(r.molecule_id, r.formula): [r[n] for n in feat.FEATURES] for r in x.collect()}
        ranked[name] = [r.formula for r in ranking.baseline(x).orderBy("rank").collect()]
    assert got.keys() == alone.keys() and all(got[k] == pytest.approx(alone[k]) for k in got)
    assert {r.molecule_id: [c.formula for c in r.ranked] for r in ranking.baseline_lists(molecules).collect()} == ranked


def test_training_lists_draw_as_training_rows(spark):
    names = [f"C{k:03d}" for k in range(400)]
    lists = spark.createDataFrame([("a", [(n,) for n in names]), ("b", [(n,) for n in names[:5]])], "like string, cands array<struct<formula:string>>")
    molecules = spark.createDataFrame([("a", "a", "C200"), ("a2", "a", "C000"), ("b", "b", "C001"), ("n", "b", "none")], "molecule_id string, like string, truth string")
    got = sorted(map(tuple, ranking.training_lists(molecules, lists, 42).collect()))
    rows = molecules.join(lists, "like").select("molecule_id", F.posexplode("cands").alias("k", "c")).select("molecule_id", "c.formula", (F.col("k") + 1).alias("rank"))
    want = ranking.training_rows(rows, molecules.select("molecule_id", F.col("truth").alias("formula")), 42).select("molecule_id", "formula", "rank", "label")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 256 + 256 + 5

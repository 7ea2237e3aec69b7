"""Queries without SQL take every molecule of the table and the engine's own limits."""

import os

import pytest

from ionflow.plans import catalog, derived

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_predictions_of_every_molecule(spark):
    every = {r[0] for r in derived.spectra(spark, DATA).select("molecule_id").distinct().collect()}
    assert {r.molecule_id for r in catalog.q_predict(spark, DATA).collect()} == every


def test_label_of_every_molecule_is_a_candidate(spark):
    x = derived.spectra(spark, DATA).where("adduct = '[M+H]+' and ionization_mode is distinct from 'negative' and molecular_formula not like '%+' and abs(row_ord % 51 - 24.7) < 9.5")
    labels = {(r[0], r[1]) for r in x.select("molecule_id", "molecular_formula").collect()}
    assert len(labels) > 20
    for name in ("q_features", "q_baseline_rank"):
        of = {}
        for r in catalog.queries()[name](spark, DATA).select("molecule_id", "formula").collect():
            of.setdefault(r[0], set()).add(r[1])
        assert all(f in of.get(m, ()) for m, f in labels)
        assert any("S" in f or "P" in f for x in of.values() for f in x)
    # a molecule gives training rows if its truth is one of several candidates
    truth = {}
    for r in derived.spectra(spark, DATA).select("molecule_id", "molecular_formula").collect():
        truth[r[0]] = min(truth.get(r[0], r[1]), r[1])
    rows = {r[0] for r in catalog.q_training_rows(spark, DATA).select("molecule_id").collect()}
    assert rows == {m for m, x in of.items() if truth[m] in x and len(x) > 1}

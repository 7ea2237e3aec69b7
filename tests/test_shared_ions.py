"""An ion is asked once at an m/z, whatever list it stands in; feature tables come as columns and equal the rows that Spark unnests and rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionflow.config import EngineConfig
from ionflow.operators import candidates as cand, features as feat, kernel, spectra as S
from ionflow.plans import catalog, derived
from ionflow.sources import tables

LIMITS = {"C": 10, "H": 24, "N": 2, "O": 8}


def _lists(rng, n):
    """Lists of ions that overlap; metals and negative counts are among them."""
    every = np.concatenate([rng.integers(0, 9, (40, 4)), np.zeros((40, 6), int), rng.integers(0, 2, (40, 2))], axis=1).astype(np.int64)
    every[:, 1] += 2 * every[:, 0]
    every[3, 1] = -1
    return [every[np.sort(rng.choice(40, 12, replace=False))] for _ in range(n)]


def _peaks(rng):
    sizes = rng.integers(0, 12, 30)
    sizes[4] = 0
    return np.round(rng.uniform(20, 260, 400), 3)[rng.integers(0, 400, sizes.sum())], rng.uniform(0.01, 1, sizes.sum()), sizes


def test_an_ion_is_searched_once_in_all_lists(monkeypatch):
    monkeypatch.setattr(kernel, "_KNOWN", {})
    kernel._FRAGMENTS.clear()
    searched, inner = [], kernel.Lattice.search
    monkeypatch.setattr(kernel.Lattice, "search", lambda self, target, tol, most: searched.append(target) or inner(self, target, tol, most))
    ions = np.array([[6, 13, 0, 6, 0, 0, 0, 0, 0, 0, 0, 0], [9, 9, 0, 4, 0, 0, 0, 0, 0, 0, 0, 0], [5, 11, 0, 5, 0, 0, 0, 0, 0, 0, 0, 0]])
    for own in ([0, 1, 2], [0, 1], [1, 2], [2]):
        kernel.fragments(ions[own], 1, 0.002, 10, 250_000).evidence(np.array([31.01839, 145.0495352]), np.array([0.2, 0.3]), np.array([1, 1]))
    assert len(searched) == 2


@pytest.mark.parametrize("da,most", [(0.002, 250_000), (0.5, 250_000), (0.5, 40)])
def test_evidence_of_a_list_is_that_of_the_list_alone(da, most, monkeypatch):
    monkeypatch.setattr(kernel, "_KNOWN", {})
    kernel._FRAGMENTS.clear()
    rng = np.random.default_rng(5)
    mzs, powers, sizes = _peaks(rng)
    some = 0
    for charge in (1, -1):
        for ions in _lists(rng, 6):
            got, over = kernel.fragments(ions, charge, da, 10, most).evidence(mzs, powers, sizes)
            want, too = kernel.Fragments(ions, charge, da, 10, most).evidence(mzs, powers, sizes)
            assert (over == too).all() and got == pytest.approx(want)
            starts = np.cumsum(sizes) - sizes
            for k in np.flatnonzero(~over):
                one = slice(starts[k], starts[k] + sizes[k])
                assert got[k] == pytest.approx(kernel.fragment_evidence(ions, mzs[one], powers[one], charge, da, 10, most))
            some += over.sum()
    assert (some > 0) == (most == 40)


def test_half_up_is_sparks_round(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 4000, 4000) / 128, rng.uniform(0, 10, 2000), np.nextafter(rng.integers(0, 999, 999) / 128, 1), (rng.integers(0, 10**6, 999) + 0.5) / 1e6, -rng.integers(0, 400, 400) / 128, [0.0, 1e6, 123456789012.3456785, 5e-7, 4.9e-7]])
    want = [r.y for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert kernel.half_up(x, 6).tolist() == want
    odd = kernel.half_up(np.array([np.nan, np.inf, -np.inf]), 6)
    assert np.isnan(odd[0]) and odd[1:].tolist() == [np.inf, -np.inf]


def test_feature_tables_are_the_rounded_rows_without_unnesting(spark, tmp_path, monkeypatch):
    orders = [(k, k % 7, "FOP"[k % 3], f"{k % 5 + 1}-X") for k in range(240)]
    lines = [(k, i, (k * 7 + i * i * 3) % 120, float((k + 5 * i) % 50 + 1)) for k in range(240) for i in range(k % 9)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    config = EngineConfig(element_limits=LIMITS)
    x = S.normalize(S.with_ids(derived.spectra(spark, str(tmp_path))), config).where("charge is not null")
    # each molecule has an alike one
    x = tables.materialize(x.unionByName(x.withColumn("molecule_id", F.concat(F.lit("N"), "molecule_id"))), "twice")
    own, lists, _ = cand.lists(x, config)
    own = own.select("molecule_id", "like", "deal")
    rows = feat.rows_of(feat.of_lists(own, lists, x, config))
    table = feat.table_of_lists(own, lists, x, config, 6)
    assert "Generate" not in table._jdf.queryExecution().executedPlan().toString()
    want = {(r.molecule_id, r.formula): list(r)[2:] for r in rows.select("molecule_id", "formula", *(F.round(n, 6) for n in feat.FEATURES)).collect()}
    got = {(r.molecule_id, r.formula): list(r)[2:] for r in table.collect()}
    assert got.keys() == want.keys() and len(got) == table.count() > 100
    assert all(got[k] == pytest.approx(want[k], abs=1.01e-6) for k in got)
    assert table.columns == ["molecule_id", "formula", *feat.FEATURES]
    # the same where a few spectra and molecules are taken at a time
    groups = feat._grouped(own, lists, x).toArrow().combine_chunks().to_batches()[0]
    whole = [np.concatenate([numbers.ravel(), over]) for _, _, _, numbers, over in feat._parts(groups, config)]
    monkeypatch.setattr(feat, "_CELLS", 3)
    parts = {}
    for _, cands, at, numbers, over in feat._parts(groups, config):
        parts.setdefault(cands.start, []).append((numbers, over))
    assert len(whole) == len(parts) < sum(map(len, parts.values()))
    for one, some in zip(whole, parts.values()):
        assert one == pytest.approx(np.concatenate([np.concatenate([n for n, _ in some], axis=1).ravel(), *(o for _, o in some)]))


def test_q_features_is_the_table_of_columns(monkeypatch):
    monkeypatch.setattr(catalog, "_whole", lambda spark, sf_dir, features=None, *more: (features, *more))
    assert catalog.q_features(None, "") == (feat.table_of_lists, 6)

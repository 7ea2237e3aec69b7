import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionflow.config import EngineConfig
from ionflow.constants import ADDUCTS, shift
from ionflow.functions import chemistry as C
from ionflow.operators import candidates as cand, kernel

GLUCOSE = 180.063388104
#: m/z of glucose by adduct.
MZ = (181.07066456, 198.09721366, 163.06009988, 145.04953520, 203.05260881, 219.02654601, 179.05611163, 161.04554695, 225.06159093, 215.03278936)


def test_masses_and_adducts():
    assert C.mass_of(C.parse("C6H12O6")) == pytest.approx(GLUCOSE, abs=1e-8)
    for (_, delta, charge), mz in zip(ADDUCTS, MZ):
        assert GLUCOSE + shift(delta, charge) == pytest.approx(mz, abs=2e-7)


def test_parse_and_format_columns(spark):
    texts = ["C6H12O6", "H12O6C6", "C6H12O6+", "C0H2", "C6H12O6junk", "NaCl", "", "C1.5H3", None, "C2H6OC", "H2O", "CH4", "Cl2H2Br"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.parse_formula(F.col("t")).alias("v"))
    for r in rows.select("t", "v", C.format_formula(F.col("v")).alias("f"), C.exact_mass(F.col("v")).alias("m")).collect():
        assert r.v == C.parse(r.t)
        assert r.f == (None if r.v is None else C.formatted(r.v))
        assert r.m is None or r.m == pytest.approx(C.mass_of(r.v))


def test_adduct_columns_agree(spark):
    x = C.with_adduct(spark.createDataFrame([(a[0],) for a in ADDUCTS] + [("[2M+H]+",)], "adduct string"))
    got = {r.adduct: r.mz for r in x.select("adduct", C.mz(F.lit(GLUCOSE), F.col("shift")).alias("mz")).collect()}
    assert got.pop("[2M+H]+") is None
    for (name, _, _), mz in zip(ADDUCTS, MZ):
        assert got[name] == pytest.approx(mz, abs=2e-7)


def brute(limits, target, tol):
    if target <= 0:
        return set()
    v = np.array(list(itertools.product(*(range(n + 1) for n in limits))))
    m = v @ kernel.MASSES
    return {tuple(x) for x in v[(abs(m - target) <= tol + 1e-9) & (v.sum(axis=1) > 0)].tolist()}


@pytest.mark.parametrize("limits,target,tol", [([4, 10, 2, 3, 0, 0, 0, 0, 0, 0], 60.05, 0.06), ([8, 20, 0, 8, 0, 0, 0, 0, 0, 0], GLUCOSE, 0.001), ([8, 20, 0, 8, 0, 0, 0, 0, 0, 0], -10.0, 0.001), ([4, 10, 2, 3, 0, 0, 0, 0, 0, 0], 60.05, 1.4)])
def test_search_is_brute_force(limits, target, tol):
    got = [tuple(x) for x in kernel.Lattice(limits).search(target, tol, 10**6).tolist()]
    assert len(got) == len(set(got)) and set(got) == brute(limits, target, tol)


def test_search_random_targets_and_join(spark):
    limits = {"C": 3, "H": 6, "N": 1, "O": 2, "P": 1, "S": 1, "F": 2, "Cl": 1, "Br": 1, "I": 1}
    config = EngineConfig(element_limits=limits)
    targets = np.random.default_rng(371).uniform(20, 250, 12).tolist()
    keys = spark.createDataFrame([(t, 0.003) for t in targets], "target double, tol double")
    for search in (lambda: cand.search_kernel(keys, config), lambda: cand.search_join(keys, config, 260.0)):
        rows = search().collect()
        for t in targets:
            got = [tuple(r.vector) for r in rows if r.target == t]
            assert len(got) == len(set(got)) and set(got) == brute(config.limits, t, 0.003)


def test_search_limit():
    with pytest.raises(kernel.SearchLimit):
        kernel.Lattice([10, 24, 2, 8, 0, 0, 0, 0, 0, 0]).search(GLUCOSE, 0.5, 1)


def test_fragment_evidence_is_exhaustive():
    ions = np.array([[6, 13, 0, 6, 0, 0, 0, 0, 0, 0, 0, 0], [9, 9, 0, 4, 0, 0, 0, 0, 0, 0, 0, 0]])
    mzs, power = np.array([31.01839, 145.0495352, 163.06009988, 181.07066456]), np.array([0.2, 0.3, 0.7, 1.0])
    for some in (ions, ions[:1]):
        got = kernel.fragment_evidence(some, mzs, power, 1, 0.002, 10, 250_000)
        for ion, row in zip(some, got):
            sub = np.array(list(itertools.product(*(range(n + 1) for n in ion))))
            mass = sub @ kernel.ION_MASSES
            hit, total, err = 0, 0.0, 0.0
            for mz, p in zip(mzs, power):
                tol = max(0.002, mz * 1e-5)
                e = np.abs(mass[1:] - mz - kernel.ELECTRON).min() / tol
                if e <= 1 + 1e-8:
                    hit, total, err = hit + 1, total + p, err + e
            assert row[:3] == pytest.approx([hit / 4, total / power.sum(), err / hit if hit else 1.0])


def test_heavy_fragment_spends_no_budget():
    ions = np.array([[6, 13, 0, 6, 0, 0, 0, 0, 0, 0, 0, 0], [13, 25, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]])
    assert not kernel.fragment_evidence(ions, np.array([300.0]), np.array([1.0]), 1, 1.0, 10, 1)[:, :2].any()

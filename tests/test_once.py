"""What is computed once: long expressions stand in a plan once, and no task gathers a whole column."""

import os

import pytest

from ionflow.config import EngineConfig
from ionflow.operators import spectra as S
from ionflow.plans import catalog, derived

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_gather_no_column(spark):
    assert "percentile" not in _plan(catalog.q_quantiles(spark, DATA))


def test_formulas_are_parsed_once(spark):
    assert "regexp_extract_all" not in _plan(catalog.q_formula_descriptors(spark, DATA))


def test_peaks_are_merged_once(spark):
    x = S.normalize(derived.spectra(spark, DATA), EngineConfig()).select("row_ord", "peaks")
    assert _plan(x).count("array_distinct") == 1

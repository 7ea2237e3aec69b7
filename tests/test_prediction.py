import json

import pytest
from pyspark.sql import functions as F

from ionflow.config import EngineConfig
from ionflow.engine import FormulaEngine, model_directory
from ionflow.operators import spectra as S
from ionflow.sources import files

CONFIG = EngineConfig(element_limits={"C": 10, "H": 24, "N": 2, "O": 8})
GLUCOSE = {"spectrum_id": "a", "precursor_mz": 181.07066456, "adduct": "[M+H]+", "ms2_mzs": [163.06009988, 145.0495352], "ms2_normalized_intensities": [1.0, 0.4]}


@pytest.fixture(scope="module")
def engine(spark):
    return FormulaEngine(spark, CONFIG)


def test_glucose_and_its_duplicate(engine):
    one, two = engine.predict_one([GLUCOSE]), engine.predict_one([GLUCOSE, GLUCOSE | {"spectrum_id": "b"}])
    assert one["status"] == "ok" and one["candidates"][0]["formula"] == "C6H12O6" and one["candidates"][0]["supporting_spectra"] == 1
    assert one["candidates"] == two["candidates"] and two["diagnostics"]["spectra_used"] == 1


@pytest.mark.parametrize("change,status", [
    ({"precursor_mz": float("nan")}, "invalid_input"), ({"ms2_mzs": [float("inf"), 1.0]}, "invalid_input"), ({"ms2_normalized_intensities": [1.0, -1.0]}, "invalid_input"),
    ({"ms2_mzs": [1.0]}, "invalid_input"), ({"ms2_mzs": [0.0, 1.0]}, "invalid_input"), ({"ionization_mode": "negative"}, "invalid_input"), ({"instrument_type": 123}, "invalid_input"),
    ({"adduct": "[2M+H]+"}, "unsupported_input"), ({"precursor_mz": 1.1}, "no_candidates"),
])
def test_statuses(engine, change, status):
    out = engine.predict_one([GLUCOSE | change])
    assert out["status"] == status and out["candidates"] == []


def test_empty_peaks_still_give_candidates(engine):
    out = engine.predict_one([GLUCOSE | {"ms2_mzs": [], "ms2_normalized_intensities": []}])
    assert out["candidates"] and "fragment" in out["warnings"][0]


def test_inconsistent_precursors(engine):
    out = engine.predict_one([GLUCOSE, GLUCOSE | {"spectrum_id": "b", "precursor_mz": 151.0601}])
    assert "C6H12O6" in [c["formula"] for c in out["candidates"]] and any("inconsistent" in w for w in out["warnings"])


def test_conflicting_ids_and_mixed_molecules(engine):
    assert engine.predict_one([GLUCOSE, GLUCOSE | {"precursor_mz": 182.0}])["status"] == "invalid_input"
    assert engine.predict_one([GLUCOSE | {"molecule_id": "x"}, GLUCOSE | {"molecule_id": "y"}])["status"] == "invalid_input"
    assert engine.predict_one([])["status"] == "invalid_input"


@pytest.mark.parametrize("sign", [1, -1])
def test_ppm_edges(engine, sign):
    out = engine.predict_one([GLUCOSE | {"precursor_mz": 181.07066455650093 * (1 + sign * 10e-6)}])
    assert any(c["formula"] == "C6H12O6" and c["supporting_spectra"] == 1 for c in out["candidates"])


def test_limits(spark):
    wide = {"precursor_ppm": 1000.0, "element_limits": CONFIG.element_limits}
    assert FormulaEngine(spark, EngineConfig(max_search_results=1, **wide)).predict_one([GLUCOSE])["status"] == "resource_limit"
    out = FormulaEngine(spark, EngineConfig(max_candidates=1, **wide)).predict_one([GLUCOSE])
    assert out["status"] == "truncated" and len(out["candidates"]) == 1
    with pytest.raises(ValueError):
        FormulaEngine(spark, CONFIG).predict_one([GLUCOSE], top_k=True)


@pytest.mark.parametrize("adduct,mz,peak", [("[M+Na]+", 203.05260881, 185.04204413), ("[M-H]-", 179.05611163, 161.04554695), ("[M+Cl]-", 215.03278936, 34.96940126)])
def test_atom_balance(engine, adduct, mz, peak):
    rows = files.from_mappings(engine.spark, [GLUCOSE | {"adduct": adduct, "precursor_mz": mz, "ms2_mzs": [peak], "ms2_normalized_intensities": [1.0]}], "m")
    x, _, _ = engine.candidate_features(rows)
    r = x.where("formula = 'C6H12O6'").first()
    assert r.peak_fraction_mean == 1 and r.intensity_fraction_mean == 1


def test_merged_peaks(spark):
    rows = files.from_mappings(spark, [GLUCOSE | {"ms2_mzs": [100.0, 50.0, 100.0, 80.0], "ms2_normalized_intensities": [2.0, 1.0, 2.0, 0.001]}], "m")
    assert [tuple(p) for p in S.normalize(rows, CONFIG).first().peaks] == [(50.0, 0.25), (100.0, 1.0)]


def test_clean_rule(spark):
    rows = spark.createDataFrame([(k, 100.0, b, [99.0, 102.0, 102.001], [1.0, 1.0, 1.0]) for k, b in enumerate([1000.0, 999.0, None])], "k int, precursor_mz double, base_peak_intensity double, ms2_mzs array<double>, ms2_normalized_intensities array<double>")
    strict = S.clean_by_rule(rows).collect()
    assert [r.k for r in strict] == [0] and strict[0].ms2_mzs == [99.0, 102.0] and strict[0].peaks_removed == 1
    assert sorted(r.k for r in S.clean_by_rule(rows, keep_unknown_base=True).collect()) == [0, 2]


def test_parquet_batch(spark, tmp_path):
    spark.createDataFrame([(m, 181.07066456, a, [163.06], [1.0]) for m, a in (("good", "[M+H]+"), ("bad", "unsupported"))], "molecule_id string, precursor_mz double, adduct string, ms2_mzs array<double>, ms2_normalized_intensities array<double>").write.parquet(str(tmp_path / "in"))
    engine = FormulaEngine(spark, CONFIG)
    out = tmp_path / "out.jsonl"
    assert engine.predict_parquet(str(tmp_path / "in"), str(out)) == 2
    lines = [json.loads(x) for x in out.read_text().splitlines()]
    assert [x["molecule_id"] for x in lines] == ["bad", "good"] and lines[0]["status"] == "unsupported_input"
    with pytest.raises(FileExistsError):
        engine.predict_parquet(str(tmp_path / "in"), str(out))
    assert [x["molecule_id"] for x in engine.iter_predict_parquet(str(tmp_path / "in"))] == ["bad", "good"]


def test_stream(spark, tmp_path):
    from ionflow.streaming.predict_stream import predict_stream

    rows = files.from_mappings(spark, [GLUCOSE], "m").drop("row_ord").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    rows.withColumn("molecule_id", F.lit("n")).write.mode("append").parquet(str(tmp_path / "in"))
    predict_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), FormulaEngine(spark, CONFIG))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.molecule_id for r in got.collect()) == ["m", "n"] and {r.candidates[0].formula for r in got.collect()} == {"C6H12O6"}


def test_config_and_models(tmp_path):
    with pytest.raises(ValueError):
        EngineConfig.from_dict({"typo": 1})
    with pytest.raises(ValueError):
        EngineConfig(max_peaks=True)
    assert EngineConfig.from_dict({"formula": {"max_peaks": 5}, "max_peaks": 7}).max_peaks == 5
    assert EngineConfig(precursor_ppm=5).version != EngineConfig(precursor_ppm=5.0).version
    with pytest.raises(FileNotFoundError):
        model_directory("none", base=str(tmp_path))

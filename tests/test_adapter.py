"""The facade's precedence of settings and checks, and the shape of the command line."""

import json
import os

import pytest

from ionflow import adapter, cli
from ionflow.adapter import FormulaAdapter
from ionflow.sources import files

SPECTRUM = {"precursor_mz": 181.07066456, "adduct": "[M+H]+", "ms2_mzs": [163.06009988, 145.0495352], "ms2_normalized_intensities": [1.0, 0.4]}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("spectra") / "in.parquet")
    rows = [(f"m{k}", f"s{k}", SPECTRUM["precursor_mz"] + k * 1e-4, "[M+H]+", SPECTRUM["ms2_mzs"], SPECTRUM["ms2_normalized_intensities"]) for k in range(4)]
    spark.createDataFrame(rows, "molecule_id string, spectrum_id string, precursor_mz double, adduct string, ms2_mzs array<double>, ms2_normalized_intensities array<double>").coalesce(1).write.parquet(path)
    return path


def test_the_nearest_setting_wins(spark, monkeypatch):
    monkeypatch.setitem(adapter.CONFIG, "top_k", 3)
    plain = FormulaAdapter(spark=spark)
    assert plain.top_k == 3 and len(plain.predict([SPECTRUM])["candidates"]) == 3
    two = FormulaAdapter(spark=spark, top_k=2)
    assert len(two.predict([SPECTRUM])["candidates"]) == 2 and len(two.predict([SPECTRUM], top_k=1)["candidates"]) == 1
    info = plain.model_info
    assert info["model_version"] == "baseline" and info["formula_config"]["max_peaks"] == 128 and info["trees"] == 0
    for bad in (0, True, 2.0, "3"):
        for make in (lambda: FormulaAdapter(spark=spark, top_k=bad), lambda: FormulaAdapter(spark=spark, workers=bad), lambda: plain.predict([SPECTRUM], top_k=bad)):
            with pytest.raises(ValueError, match="positive integer"):
                make()


def test_models_are_presets_or_folders(spark, tmp_path, monkeypatch):
    for bad in ("", 5):
        with pytest.raises(TypeError):
            FormulaAdapter(bad, spark=spark)
    with pytest.raises(FileNotFoundError, match="model.json"):
        FormulaAdapter(str(tmp_path), spark=spark)
    from ionflow.config import EngineConfig
    from ionflow.operators.ranking import Ranker

    config = EngineConfig()
    (tmp_path / "model.json").write_text(json.dumps(Ranker([], 0.1).to_dict()))
    files.write_json(str(tmp_path / "metadata.json"), {"config": config.to_dict(), "config_version": config.version})
    monkeypatch.setitem(adapter.PRESETS, "own", str(tmp_path))
    for name in ("own", str(tmp_path), str(tmp_path / "model.json")):
        one = FormulaAdapter(name, spark=spark)
        assert one.model_info["model_path"] == os.path.realpath(tmp_path) and one.model_info["model_version"].startswith("ranker-")
    monkeypatch.setitem(adapter.CONFIG, "model", "own")
    assert FormulaAdapter(spark=spark).model == "own" and adapter.predict_formula([SPECTRUM])["model_version"].startswith("ranker-")


def test_files_of_predictions(spark, table, tmp_path):
    out = str(tmp_path / "new" / "out.jsonl")
    one = FormulaAdapter(spark=spark, top_k=2)
    got = one.predict_parquet(table, output=out)
    assert [r["molecule_id"] for r in got] == ["m0", "m1", "m2", "m3"] and [json.loads(x)["molecule_id"] for x in open(out)] == ["m0", "m1", "m2", "m3"]
    with pytest.raises(FileExistsError):
        one.predict_parquet(table, output=out)
    assert one.predict_parquet(table, workers=3) == got
    with pytest.raises(ValueError):
        files.write_lines([{"x": float("nan")}], str(tmp_path / "nan.jsonl"))


def test_command_line(spark, table, tmp_path, capsys):
    config = tmp_path / "c.json"
    out = str(tmp_path / "p.jsonl")
    config.write_text(json.dumps({"input": table, "output": out, "max_candidates": 5}))
    assert cli.run(["formula", "predict", "--config", str(config), "--top-k", "9", "--workers", "2"]) == 0
    assert json.loads(capsys.readouterr().out) == {"molecules": 4, "output": out}
    assert all(len(json.loads(x)["candidates"]) <= 5 for x in open(out))
    other = str(tmp_path / "q.jsonl")  # the command line wins
    assert cli.run(["predict", "--input", table, "--output", other, "--config", str(config)]) == 0 and os.path.exists(other)
    assert cli.run(["formula", "audit", "--input", table]) == 0
    capsys.readouterr()
    for args, text in (
        (["formula", "predict", "--output", "x"], "input is required"), (["predict", table], "output is required"), (["predict", table, "--output", table], "same file"),
        (["predict", table, "--output", "x", "--top-k", "0"], "top_k"), (["evaluate", "--input", "none", "--output", "x"], "error"),
    ):
        assert cli.run(args) == 2
        err = capsys.readouterr().err
        assert err.startswith("error: ") and text in err
    config.write_text(json.dumps({"input": table, "typo": 1}))
    assert cli.run(["audit", "--config", str(config)]) == 2 and "typo" in capsys.readouterr().err
    config.write_text(json.dumps({"formula": {"max_peaks": 3}, "max_peaks": 7}))
    assert cli.settings(str(config))[1].max_peaks == 3 and cli.settings(None) == ({}, None)
    with pytest.raises(SystemExit):
        cli.run(["formula", "unknown"])

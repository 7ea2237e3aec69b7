"""The jobs: their SQL on given tables, growing input, reruns, and odd rows."""

import json
import os
import shutil

import pytest

from jobs import common, formula_mentions as fm, prepare_library as pl, registry

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, token string, n int"


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def _same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or abs(x - y) < 1e-6 for x, y in zip(a, b)), (a, b)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_job_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = registry.queries()[name](spark, DATA)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in cur.fetchall()), key=str)
    assert sorted(df.columns) == sorted(names) and want
    _same(_rows(df), want)


def _write(spark, folder, name, rows):
    """One more file of a growing table."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}-{name}")
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in os.listdir(f"{folder}-{name}") if f.endswith(".parquet"))
    shutil.move(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")


def test_mentions_of_growing_documents(spark, tmp_path, caplog):
    docs, out, mark = (f"{tmp_path}/{x}" for x in ("documents", "out", "mark"))
    first = [
        (1, "Water H2O, and CO2; CO2 again. (C6H12O6)", "en", "x", 1), (2, "OCO is CO2 too", "de", "x", 1), (3, None, "en", "x", 1), (4, "", None, "x", 1),
        (5, "no formulas: Hello H2 Co C0 H02 C1234567890 CH3-", None, "x", 1), (None, "NaCl HCl", "en", "x", 1), (6, "x" * 200_000 + " CCl4 " + "CBr4 " * 3, "en", "x", 1),
    ]
    _write(spark, docs, "a", first)
    with caplog.at_level("INFO", logger="ionflow.jobs"):
        got = {r.formula: (r.documents, r.mentions, r.first_doc_id, r.mass_bin) for r in fm.run(spark, docs, out, mark).collect()}
    assert got == {
        "H2O": (1, 1, 1, "<300"), "CO2": (2, 4, 1, "<300"), "C6H12O6": (1, 1, 1, "<300"), "CH3": (1, 1, 5, "<300"), "ClH": (0, 1, None, "<300"), "CCl4": (1, 1, 6, "<300"), "CBr4": (1, 3, 6, "300-600"),
    }
    assert "read 7 new documents" in caplog.text and "wrote 7 formulas" in caplog.text
    again = fm.run(spark, docs, out, mark)
    assert {r.formula for r in again.collect()} == set(got)
    _write(spark, docs, "b", [(2, "CO2", "de", "x", 1), (9, "H2O H2O", "fr", "x", 1), (1, "H2O", "en", "x", 1)])
    caplog.clear()
    with caplog.at_level("INFO", logger="ionflow.jobs"):
        got = {r.formula: (r.documents, r.mentions) for r in fm.run(spark, docs, out, mark).collect()}
    assert got["CO2"] == (2, 5) and got["H2O"] == (2, 4) and got["C6H12O6"] == (1, 1) and "read 3 new documents" in caplog.text
    # the same as all files at once
    whole = fm.run(spark, docs, f"{tmp_path}/whole", f"{tmp_path}/mark2")
    assert _rows(whole) == _rows(fm.run(spark, docs, out, mark))
    assert {d.split("=")[1] for d in os.listdir(f"{out}/formulas") if "=" in d} == {"<300", "300-600"}


def test_mentions_of_no_documents(spark, tmp_path):
    _write(spark, f"{tmp_path}/d", "a", [])
    assert fm.run(spark, f"{tmp_path}/d", f"{tmp_path}/o", f"{tmp_path}/m").count() == 0
    _write(spark, f"{tmp_path}/d", "b", [(1, "CO2", "en", "x", 1)])
    assert fm.run(spark, f"{tmp_path}/d", f"{tmp_path}/o", f"{tmp_path}/m").count() == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_library_runs_again_with_the_same_result(spark, tmp_path, caplog):
    out = f"{tmp_path}/library"
    with caplog.at_level("INFO", logger="ionflow.jobs"):
        first = _rows(pl.run(spark, DATA, out))
    assert "read 1500 spectra" in caplog.text
    assert _rows(pl.run(spark, DATA, out)) == first and len(first) == 1500
    # a structure is in one split and bucket
    good = spark.read.parquet(f"{out}/accepted")
    assert good.select("inchikey14", "split", "bucket").distinct().count() == good.select("inchikey14").distinct().count()
    import numpy as np

    raw = {r.row_ord: abs(r.precursor_error_ppm) for r in pl.derived.spectra(spark, DATA).select("row_ord", "precursor_error_ppm").collect()}
    by = {}
    for r in pl.run(spark, DATA, out).collect():
        by.setdefault((r.source, r.reason or "accepted"), []).append(raw[r.row_ord])
    got = spark.read.parquet(f"{out}/report").collect()
    assert {(r.source, r.reason): (r.spectra, r.error_median, r.error_p99) for r in got} == {
        k: (len(v), *(float(np.sort(v)[int(np.floor((len(v) - 1) * q + 0.5))]) for q in (0.5, 0.99))) for k, v in by.items()
    }


def test_settings(tmp_path):
    path = f"{tmp_path}/c.json"
    for text, want in (("{}", {"a": 1}), ('{"a": 3}', {"a": 3})):
        open(path, "w").write(text)
        assert common.settings(path, {"a": 1}) == want
    open(path, "w").write('{"b": 3}')
    with pytest.raises(ValueError, match="unknown settings"):
        common.settings(path, {"a": 1})
    for job in (fm, pl):
        name = job.__name__.split(".")[1]
        assert json.load(open(os.path.join(os.path.dirname(job.__file__), f"{name}.json"))) == job.DEFAULTS


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_command_line(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    args = ["--documents", f"{DATA}/documents.parquet", "--output", f"{tmp_path}/o", "--checkpoint", f"{tmp_path}/c"]
    done = subprocess.run([sys.executable, "-m", "jobs.formula_mentions", *args], cwd=root, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "wrote" in done.stderr, done.stderr[-2000:]
    assert any(f.startswith("mass_bin=") for f in os.listdir(f"{tmp_path}/o/formulas"))

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, keep string, size int, component string, digest int"
BASE = " ".join(f"word{k}" for k in range(60))


def rows():
    """Nulls, empty and white texts, copies, near copies, ties, repeated rows, long texts, shared lines, clashing columns."""
    texts = {
        0: BASE, 1: BASE + "  ", 2: BASE.replace("word30", "other"), 3: BASE.upper(), 4: None, 5: "", 6: " \t\n", 7: "one two", 8: "One  two",
        9: "A shared line of text.\nown line nine here\n  a SHARED line of text.\nshort", 10: "short\na shared line of text.\n\nown line ten here", 11: "a shared line of text.",
        12: "x" * 5000, 13: " ".join(f"w{k % 700}" for k in range(4000)), 14: "This is under the MIT License, and cc-by-nc; CC BY NC.", 15: "Apache License, Version 2.0 K", 16: "é à 日本語 😀 ▁ text",
        17: BASE.replace("word10", "a b c d").replace("word50", "q"), 18: "\x00odd\x0bbytes\x85",
    }
    out = [(k, t, "en", None if k % 7 == 3 else f"s{k % 3}", None if t is None else len(t), 99, "k", 7, "c", 1) for k, t in texts.items()]
    return out + [(11, "a shared line of text.", "en", "s2", 22, 1, "k", 7, "c", 1), (None, "a shared line of text.", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def docs_path(docs):
    return docs.inputFiles()[0].rsplit("/", 1)[0]


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)

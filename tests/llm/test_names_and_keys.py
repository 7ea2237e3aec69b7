"""Clashing column names, long words, paths that begin alike, and counts over a forest that splits."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ionflow.llm import embedding_forest as ef, exact_dedup, line_dedup, ngram_join, source_mix, textvec


def test_any_column_names(spark):
    names = ["n_lines", "N_DROPPED", "__keep", "__row", "row", "__doc", "tag", "__times", "times", "__copy", "_row", "a.b"]
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.expr("concat('a line that all of them hold\nown line of ', id)").alias("text"), F.lit("s").alias("source"), *(F.concat(F.lit(n), "id").alias(n) for n in names))
    want = {k: tuple(f"{n}{k}" for n in names) for k in range(30)}

    def others(df):
        return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}

    lines = line_dedup.dedup_lines(spark, docs)
    assert others(lines) == want and lines.columns[-2:] == ["_n_lines", "_N_DROPPED".lower()]
    assert {r.doc_id: r["_n_dropped"] for r in lines.collect()} == {k: int(k > 0) for k in range(30)}
    one = ngram_join.keep_one(spark, docs)
    assert one.columns == docs.columns and others(one).items() <= want.items()
    mixed = source_mix.mixed(spark, docs)
    assert mixed.columns == docs.columns and others(mixed).items() <= want.items() and mixed.count() > 25


def test_long_words_do_not_collide():
    """A word and its complement in the Thue-Morse order collide in any polynomial hash modulo 2^64."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << 12))
    b = a.translate(str.maketrans("ab", "ba"))
    long = "x" * (5 * textvec.CHUNK)
    texts = pa.array([a, b, a.upper(), f"{long} y", f"{long}y y", "w " * 10 + long])
    got = [h[k : k + n].tolist() for _, _, h, counts, _, _ in textvec.WordHasher(textvec.SPACED).batches(texts) for k, n in zip(np.cumsum(counts) - counts, counts)]
    assert [len(x) for x in got] == [1, 1, 1, 2, 2, 11]
    assert got[0] == got[2] != got[1] and got[3][0] != got[4][0] and got[3][1] == got[4][1] and got[5][-1] == got[3][0]


def test_exact_reads_only_its_path(spark, tmp_path):
    for name, rows in (("documents.parquet", [(1, "a b"), (2, "c")]), ("documents.parquet.old", [(3, "ab")]), ("documents.parque", [(4, "ab")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}")
    got = exact_dedup.exact_groups(spark, f"{tmp_path}/documents.parquet").collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 1, 1), (2, 2, 1)}


def test_a_hot_digest_is_dealt_to_several_tasks(spark, tmp_path):
    """Rows of one text, and of several texts under one digest, in numbers over HOT_ROWS."""
    n = exact_dedup.HOT_ROWS + 200
    rows = [(k, "a b" if k % 3 else " a  b ") for k in range(n)] + [(n + k, f"c{k % 2}") for k in range(5)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    want = {k: (0, n) for k in range(n)} | {n + k: (n + k % 2, 3 - k % 2) for k in range(5)}
    for digest in (exact_dedup.sha256, lambda norm: F.unhex(F.substring(F.concat(F.lit("0"), F.hex(F.length(norm))), 1, 1))):
        got = exact_dedup.exact_groups(spark, path, digest).collect()
        assert len(got) == len(rows) and {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_pairs_that_share_several_leaves_count_once(spark, monkeypatch):
    monkeypatch.setattr(ef, "LEAF", 8)
    monkeypatch.setattr(ef, "BLOCK", 16)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(60, 24))
    vecs = np.concatenate([base, *(base[:20] + rng.normal(size=(20, 24)) * 0.02 for _ in range(6)), base[:5]])
    x = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    want = ((x @ x.T >= 0.98).sum(axis=1) - 1).tolist()
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in ef.near_dedup(spark, df)[0].collect()}
    assert all(got[k] <= n for k, n in enumerate(want)) and sum(got.values()) >= 0.99 * sum(want)


def test_every_vector_length_is_compared(spark):
    rows = [(2 * n + k, [1.0] * (n + 1), 1) for n in range(1200) for k in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert ef.near_dedup(spark, df)[0].where("n_links <> 1 or component_id <> vec_id - vec_id % 2").count() == 0

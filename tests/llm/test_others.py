"""HTML extraction, WARC, toxicity, embeddings and the pipeline."""

import hashlib
import os

import numpy as np
import pytest

from ionflow.llm import common, embedding_forest as ef, html_crf, toxicity_crf as tox, warc_index as wi

from .conftest import SCHEMA

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chain():
    return html_crf.default_model()


def test_held_out_blocks(chain):
    pages = html_crf.labelled_pages(150, seed=99)
    got = [(y, p) for f, ys in pages for y, p in zip(ys, chain.viterbi(f))]
    assert np.mean([y == p for y, p in got]) > 0.98


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>A  title</h1><p>First &amp; para&eacute;\n of text.<br>More <b>bold</b> words.</p></article><footer>&copy; x.example</footer></body></html>", "A title First & paraé of text. More bold words."),
    ("<body><header><h1>Site</h1></header><main><h1>Title here</h1><p>First para with text in it.<p>Second para of text, unclosed.</main><div id='comments'><p>Nice post! I really liked it.</p></div><script>var a='<p>no</p>';</script><div class='cookie-notice'>We use cookies.</div>", "Title here First para with text in it. Second para of text, unclosed."),
    ("", ""), (None, ""), ("<", ""), ("<!-- only a comment", ""), ("<script>never closed <p>x</p>", ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_pages(chain, page, text):
    assert html_crf.main_text(page, chain).removesuffix("<") == text


def test_extract(spark):
    rows = [(k, f"http://x/{k}", p, 5) for k, (p, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html_crf.extract(spark, df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert html_crf.extract(spark, df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_extract_keeps_articles(spark):
    import html
    import re

    for r in html_crf.extract(spark, spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        own = r.html[r.html.index("<article>") + 9 : r.html.rindex("</article>")]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", x))).strip() for x in re.split("</?p>|</?h1>|<br>", own))
        assert r.text == " ".join(x for x in parts if x)


def test_viterbi_and_marginals_are_exact():
    rng = np.random.default_rng(1)
    import itertools

    for n in (1, 2, 5):
        e, trans = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        score = {y: sum(a * b for a, b in zip(e, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=n)}
        w = np.zeros(n)
        w[:] = e
        assert html_crf.Chain(w, trans).viterbi([[k] for k in range(n)]) == list(max(score, key=score.get))
        z = sum(np.exp(s) for s in score.values())
        want = [sum(np.exp(s) for y, s in score.items() if y[k]) / z for k in range(n)]
        counts = np.array([n, 0, n])
        p, state = tox.Chains(counts).run(np.concatenate([e, e]), trans)
        assert p == pytest.approx(want * 2)
        if n > 1:
            pair = sum(np.exp(s) / z * np.array([[(a, b) == (i, j) for j in (0, 1)] for i in (0, 1)]) for y, s in score.items() for a, b in zip(y, y[1:]))
            assert tox.Chains(np.array([n])).pairs(tox.Chains(np.array([n])).run(e, trans)[1]) == pytest.approx(pair)


def test_warc(spark, tmp_path):
    big = "<p>" + "same payload " * 20
    rows = [(5, "http://www.example.com/b?z=1&a=2", big, 1), (3, "https://example.com/a", big, 2), (9, None, big + "!", 3), (1, "http://example.com/a", None, 4), (2, "not a url", "short", 5), (4, "http://b.example.com:8080/x y#f", "short", 6), (None, "http://e.org/\r\nX: y", big, 7), (7, "http://é.example/ü", "é" * 60, 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, size int")
    folder = f"file://{tmp_path}/w"
    got = {r.page_id: r for r in wi.archive(spark, df, folder).collect()}
    assert len(got) == len(rows)
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        r = got[i]
        again = h == big and i != 3
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None)
    look = wi.Lookup(spark, folder)
    found = look.captures("https://EXAMPLE.com/a#frag")
    assert sorted(c["page_id"] for c in found) == [1, 3]
    assert look.record(next(c for c in found if c["page_id"] == 3))["payload"] == big.encode()
    assert look.captures("http://none.example/") == []
    assert wi.surt("http://www.Example.com:80/b?z=1&a=2") == "com,example,www)/b?a=2&z=1"
    assert wi.archive(spark, df.limit(0)).count() == 0


def test_index_over_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wi, "BLOCK_LINES", 7)
    df = spark.range(300).selectExpr("id as page_id", "concat('http://h', id % 13, '.example/', id % 50) as url", "repeat(cast(id as string), 60) as html")
    folder = f"file://{tmp_path}/w"
    got = wi.archive(spark, df, folder)
    assert got.count() == 300
    look = wi.Lookup(spark, folder)
    for k in (0, 12, 49, 120):
        assert k in {c["page_id"] for c in look.captures(f"http://h{k % 13}.example/{k % 50}")}


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    vecs = [b for b in base] + [b + rng.normal(size=16) * 0.05 for b in base for _ in range(3)] + [base[0]] * 5 + [2 * base[1]]
    rows = [(k, [float(np.float32(x)) for x in v], k % 2 if k >= 40 else k % 2) for k, v in enumerate(vecs)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, [1.0] * 16, None), (n + 5, [1.0] * 16, None), (n + 6, [1.0] * 8, 1), (n + 7, [1.0] * 8, 1), (n + 8, [1e300] * 8, 1), (n + 9, [], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, rep long")
    usable = [(i, np.array(v), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    top, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for i, x, y in usable:
        for j, z, t in usable:
            if i != j and y == t and len(x) == len(z) and (x / abs(x).max()) @ (z / abs(z).max()) / np.linalg.norm(x / abs(x).max()) / np.linalg.norm(z / abs(z).max()) >= 0.98:
                links[i] += 1
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    got = ef.near_dedup(spark, df)[0].collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, links[i], find(i), find(i) == i) for i in top}
    assert ef.near_dedup(spark, df.limit(0))[0].count() == 0


def test_forest_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ef, "LEAF", 16)
    monkeypatch.setattr(ef, "BLOCK", 8)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 32))
    vecs = np.concatenate([base, base + rng.normal(size=base.shape) * 0.1])
    x = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)))}
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int")
    got = {(r.a, r.b) for r in ef.near_dedup(spark, df)[1].collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 100


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (20, 10), (10, 30), (30, 40), (40, 50), (50, 60), (2, 1)]
    out = common.components(spark, spark.createDataFrame(edges, "a long, b long"), common.workdir(spark, "test"))
    assert {r.node: r.component for r in out.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{k: 10 for k in (10, 20, 30, 40, 50, 60)}}


def toxic_data(spark):
    rng = np.random.default_rng(6)
    words = np.array([f"{a}{b}" for a in ("al", "be", "co", "du", "er", "fa") for b in ("ra", "mi", "to", "nu", "so", "le", "ki")])
    docs, labels = [], []
    for i in range(600):
        w = rng.choice(words, rng.integers(20, 80)).tolist()
        bad = i % 4 == 0
        if bad:
            for k in rng.choice(len(w), 3, replace=False):
                w[k] = rng.choice(["nastyword", "vilething", "Awfulness!"])
        docs.append((i, " ".join(w), "en", "s", 1, 1, "k", 1, "c", 1))
        labels.append((i, 1, int(bad)))
    docs += [(600, None, None, None, None, 1, "k", 1, "c", 1), (601, "", None, None, 0, 1, "k", 1, "c", 1), (None, "x nastyword vilething y", None, None, 0, 1, "k", 1, "c", 1), (5, "vilething nastyword z", None, None, 0, 1, "k", 1, "c", 1)]
    labels += [(700, 1, None), (2, 1, 1), (None, 0, 1)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    import zlib

    docs, labels = toxic_data(spark)
    rows = tox.score(spark, docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert [got[i][0].predicted for i in range(600) if i != 5] == [int(i % 4 == 0) for i in range(600) if i != 5]
    assert got[None][0].predicted == 1 and got[600][0].predicted == got[601][0].predicted == 0
    text = {r.doc_id: r.text for r in docs.collect()}
    found = {w.strip("!") for i in range(0, 600, 4) for s in got[i][0].spans for w in text[i][s.start : s.end].split()}
    assert found == {"nastyword", "vilething", "Awfulness"}
    kept = tox.keep_clean(spark, docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 600, 601}
    assert tox.score(spark, docs.limit(0), labels).count() == 0
    assert {r.score for r in tox.score(spark, docs, labels.limit(0)).collect()} == {0.0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_is_its_stages(spark):
    import corpus_pipeline as cp
    from ionflow.llm import line_dedup, ngram_join, sentencepiece_fst, source_mix

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = common.saved(tox.score(spark, docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0").select("doc_id").join(docs, "doc_id").select(docs.columns), common.workdir(spark, "t"))
    assert {r.doc_id for r in cp.STAGES[0][1](spark, docs, SF).collect()} == {r.doc_id for r in clean.collect()}
    lines = common.saved(line_dedup.dedup_lines(spark, clean).select(docs.columns), common.workdir(spark, "t"))
    comp = ngram_join.jaccard_components(spark, lines)[0]
    one = common.saved(lines.join(comp.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi"), common.workdir(spark, "t"))
    times = {r.doc_id: round(r.taken / r.size + 1e-9) for r in source_mix.mix(spark, one).collect() if r.size}
    got = cp.run(spark, SF).collect()
    assert {i: n for i, n in times.items() if n} == {i: sum(r.doc_id == i for r in got) for i in {r.doc_id for r in got}}
    fst = sentencepiece_fst.Transducer(sentencepiece_fst.load(sentencepiece_fst.MODEL))
    text = {r.doc_id: r.text for r in one.collect()}
    assert all(r.ids == fst.encode(text[r.doc_id]).tolist() for r in got)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns

"""Operators 11 and 12 against brute force: ranking by full scores, ids by the library text by text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionflow.llm import threshold_search as ts, token_files as tf

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, k=10):
    own = [(i, _terms(t)) for i, t in docs]
    total, length = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    df = Counter(t for _, w in own for t in set(w))
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(_terms(t))
    out = []
    for item, terms in wanted.items():
        found = []
        for doc, w in own:
            tf_, m = Counter(w), 25 + 75 * len(w) * total // length if length else 0
            score = sum(c * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * tf_[t] // (1000 * tf_[t] + 8 * m)) for t, c in terms.items() if tf_[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def _search(spark, docs, items, **more):
    out = ts.search(spark, spark.createDataFrame(docs, "doc_id long, text string, score int, rank string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **more)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def _with_names(rows):
    return [(k, t, 1, "x") for k, t in rows]


@pytest.mark.parametrize("block", [3, 2048])
def test_search_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ts, "BLOCK_DOCS", block)
    monkeypatch.setattr(ts, "FIRST_DEPTH", 2)
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(60)] + ["É", "日本", "Straße", "x_y", "a-b"]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(k, " ".join(rng.choice(words, rng.integers(1, 80), p=p / p.sum()))) for k in range(220)]
    docs += [(300, None), (301, ""), (302, " ,;\n"), (5, docs[6][1]), (None, docs[3][1]), (400, docs[2][1]), (401, docs[2][1].upper()), (402, "rare " * 30_000 + "w1"), (403, "rare\x7fw2")]
    items = [(k, " ".join(rng.choice(words, 12))) for k in range(15)] + [(20, "rare RARE w1"), (21, None), (22, "absent"), (23, ""), (3, "w9 w9"), (None, "w1 w2")]
    assert _search(spark, _with_names(docs), items) == _brute(docs, items)


def test_search_of_empty_tables_and_few_hits(spark):
    assert _search(spark, [], [(1, "a")]) == _search(spark, _with_names([(1, "a")]), []) == []
    docs, items = [(1, "a b"), (2, "b"), (3, None)], [(7, "a a B")]
    assert _search(spark, _with_names(docs), items) == _brute(docs, items)


def test_items_are_taken_in_batches(spark, monkeypatch):
    monkeypatch.setattr(ts, "BATCH_TERMS", 3)
    docs, items = [(k, f"a b{k} c{k % 3}") for k in range(40)], [(k, f"a b{k} c1 c2") for k in range(12)]
    assert _search(spark, _with_names(docs), items, k=4) == _brute(docs, items, 4)


def test_threshold_stops_before_all_documents_are_looked_up():
    rng = np.random.default_rng(1)
    doc, term = np.repeat(np.arange(1000), 3), np.tile(np.arange(3), 1000)
    block = ts.Block(np.arange(1000), doc, term, rng.integers(1, 1000, 3000).astype(np.int64) ** 2, 3)
    best, looked = block.search(np.arange(3), np.array([5, 1, 2]), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10)
    full = block.forward.astype(np.int64) @ np.array([5, 1, 2])
    want = np.lexsort((np.arange(1000), -full))[:10]
    assert best[1].tolist() == want.tolist() and best[0].tolist() == full[want].tolist() and looked < 500


def test_search_equal_scores_at_the_threshold():
    """All documents score alike, so that only a threshold strictly below the kth score may end the block."""
    block = ts.Block(np.arange(100)[::-1], np.arange(100), np.zeros(100, np.int64), np.full(100, 7), 1)
    best, looked = block.search(np.array([0]), np.array([1]), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 4)
    assert best[1].tolist() == [0, 1, 2, 3] and looked == 100


# Token files
TEXTS = [
    "Plain words, and more words.", "two  spaces  here ", " lead", "line\nline two\n\nthird\n\n\n  fourth\n", "\t tabs\tand\x85next\xa0line", "\x1fodd \x1f odd", "don't we'll 'S", "日本語 😀 é ñ ﷽", "<|endoftext|> a<|endoftext|>",
    "", None, " ", "\n", "\n\n", " \n ", "a b  c", "x" * 3000, "12 345, 6.7e8", "a\n b", "a \nb", "a \n b", "end.\r\nNext\r\n", "\x00\x01 nul", "a\n\n\nb c",
]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path(tf.TOKENIZER)


@pytest.fixture(scope="module")
def library(model):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(model)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_equals_the_library(model, library, monkeypatch):
    rng = np.random.default_rng(0)
    signs = list("ab  \n\n.,'s\t1é　\x1c_")
    texts = TEXTS + ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000)]
    for known in (10, 200_000):
        monkeypatch.setattr(tf, "_KNOWN", known)
        e = tf.Encoder(model)
        for lo in range(0, len(texts), 100):
            ids, n = e.encode([t or "" for t in texts[lo : lo + 100]])
            for t, part in zip(texts[lo : lo + 100], np.split(ids, np.cumsum(n)[:-1])):
                assert part.tolist() == library(t)[:-1], repr(t)


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 5000):
        keys = tf.key_hash(np.arange(n), np.zeros(n, np.int64))
        m = tf.Mphf.build(keys)
        again, size = tf.Mphf.unpack(m.pack() + b"more")
        assert sorted(m.slots(keys)) == list(range(n)) and (again.slots(keys) == m.slots(keys)).all() and size == len(m.pack())
    bits = 8 * len(m.pack()) / n
    assert bits < 5
    raw = tf.Bucket.pack(keys, np.arange(n) % 7, np.arange(n) * 10, np.full(n, 3))
    ok, row = tf.Bucket(raw).find(keys)
    assert ok.all() and (row["start"] == np.arange(n) * 10).all() and (row["shard"] == np.arange(n) % 7).all()
    assert not tf.Bucket(raw).find(tf.key_hash(np.arange(n, 3 * n), np.zeros(2 * n, np.int64)))[0].any()


def _want(rows, library):
    """Rows in the order of doc_id; of rows that repeat one, in any order."""
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = library(text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_encoded_against_the_library(spark, tmp_path, library):
    rows = [(7 * k % 101, t) for k, t in enumerate(TEXTS)] + [(200 + k, f"some text {k} " * 3) for k in range(300)] + [(None, "no id"), (-5, "negative"), (2**62, "long " * 40_000)]
    df = spark.createDataFrame([(k, t, 1, "n", 2, "h") for k, t in rows], "doc_id long, text string, n int, shard string, k int, h string").repartition(4)
    got = tf.encoded(spark, df, f"file://{tmp_path}/a")
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _want(rows, library)
    reader = tf.Reader(spark, f"file://{tmp_path}/a")
    assert all(reader.ids(k).tolist() == library(t) for k, t in rows)
    assert all(reader.ids(k) is None for k in (-1, 10**6, 10**9)) and reader.ids(200, 1) is None
    assert tf.encoded(spark, df.limit(0)).count() == 0


def test_one_document_id_may_hold_most_rows(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(tf, "BUCKET", 16)
    rows = [(3, f"text {k % 50} of three") for k in range(400)] + [(k, f"own {k}") for k in range(40) if k != 3]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = tf.encoded(spark, df, f"file://{tmp_path}/b").collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, n, c) for d, _, n, c in _want(rows, library))
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    reader = tf.Reader(spark, f"file://{tmp_path}/b")
    assert Counter(tuple(reader.ids(3, k)) for k in range(400)) == Counter(tuple(library(t)) for d, t in rows if d == 3) and reader.ids(3, 400) is None
    assert spark.read.parquet(f"file://{tmp_path}/b/manifest").where("first = 3").count() > 1  # spread over shards


def test_search_result_is_stable_over_partitions(spark):
    docs = [(k, f"a b c{k % 4}") for k in range(60)]
    frames = [spark.createDataFrame(docs, "doc_id long, text string").repartition(n, F.col("doc_id")) for n in (1, 7)]
    items = spark.createDataFrame([(1, "a c1 c2")], "item_id long, text string")
    one, two = (sorted(map(tuple, ts.search(spark, f, items).collect())) for f in frames)
    assert one == two and len(one) == 10

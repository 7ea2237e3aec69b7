"""Operators on documents against brute force, over rows with nulls, copies, ties, long texts and clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionflow.llm import exact_dedup, license_diagonal, line_dedup, ngram_join, queries, sentencepiece_fst as sp, source_mix

from .conftest import rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pairs():
    return [(r[0], r[1] or "", r[3]) for r in rows()]


def test_exact(spark, docs_path, none):
    groups = defaultdict(list)
    for i, t, _ in pairs():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i))
    want = Counter((i, sorted(g)[0][2], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, _, i in g)
    weak = lambda n: F.unhex(F.substring(F.sha2(n, 256), 1, 1))
    for digest in (exact_dedup.sha256, weak):
        got = exact_dedup.exact_groups(spark, docs_path, digest).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got if r.doc_id is not None)
    assert exact_dedup.exact_groups(spark, none.inputFiles()[0].rsplit("/", 1)[0]).count() == 0


def test_exact_state_goes_on(spark, tmp_path):
    path, cp = str(tmp_path / "documents.parquet"), str(tmp_path / "cp")
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(path)
    exact_dedup.update_state(spark, path, cp)
    spark.createDataFrame([(2, "a  b"), (3, "c")], "doc_id long, text string").write.mode("append").parquet(path)
    state = {r["size"]: -r.best.neg_id for r in exact_dedup.update_state(spark, path, cp).collect()}
    assert state == {2: 2, 1: 3}


def line_key(x):
    return x.strip(" \t\n\x0b\x0c\r").translate(LOW)


def test_lines(spark, docs, none):
    last = 2**63 - 1
    low = {}
    for i, t, _ in pairs():
        for x in t.split("\n"):
            k = line_key(x)
            if len(k) >= 10:
                low[k] = min(low.get(k, last), last if i is None else i)
    want = Counter()
    for i, t, _ in pairs():
        kept = [x for x in t.split("\n") if len(line_key(x)) < 10 or low[line_key(x)] == (last if i is None else i)]
        want[i, "\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept)] += 1
    out = line_dedup.dedup_lines(spark, docs)
    assert Counter((r.doc_id, r.text, r["_n_lines"], r.n_dropped) for r in out.collect()) == want
    assert set(docs.columns) <= set(out.columns)
    assert line_dedup.dedup_lines(spark, none).count() == 0


def test_runs_over_partitions():
    import pyarrow as pa

    n = 1000
    doc = np.arange(n)
    cols = [np.zeros(n, np.int64), np.zeros(n, np.int64), doc, doc, np.zeros(n, np.int32)]
    names = ["h1", "h2", "doc", "tag", "pos"]
    kinds = Counter()
    low = {}
    for part in (slice(0, 300), slice(300, 700), slice(700, n)):
        batches = [pa.record_batch([pa.array(c[part][k : k + 100]) for c in cols], names=names) for k in range(0, len(doc[part]), 100)]
        for b in line_dedup._first_runs(iter(batches)):
            for r in b.to_pylist():
                kinds[r["kind"]] += 1
                if r["kind"] == 2:
                    low[r["h1"]] = min(low.get(r["h1"], n), r["doc"])
    assert kinds == {1: n, 2: 6} and low == {0: 0}


def sets():
    out = []
    for i, t, _ in pairs():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def test_jaccard(spark, docs, none):
    top = {i: i for i, _ in sets()}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for i, x in sets():
        for j, y in sets():
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    out, links = ngram_join.jaccard_components(spark, docs)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == Counter((i, len(s), None if i is None else find(i)) for i, s in sets())
    assert ngram_join.jaccard_components(spark, none)[0].count() == 0
    kept = ngram_join.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({find(i) for i, _ in sets() if i is not None})


def test_jaccard_long_lists(spark):
    """Many near copies, some linked only to others, and a passage that many texts share."""
    rng = np.random.default_rng(5)
    base, shared, data = [f"b{k}" for k in range(80)], [f"p{k}" for k in range(30)], []
    for i in range(60):
        w = list(base)
        for k in rng.choice(80, rng.integers(1, 5), replace=False):
            w[k] = f"e{i}x{k}"
        data.append((i, " ".join(w)))
    for i in range(60, 110):
        data.append((i, " ".join(shared + [f"u{i}x{k}" for k in range(rng.integers(2, 40))])))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark, spark.createDataFrame(data, "doc_id long, text string"))[0].collect()}
    own = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in data}
    top = {i: i for i in own}
    for _ in range(len(own)):
        for i in own:
            for j in own:
                if 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]):
                    top[i] = top[j] = min(top[i], top[j])
    assert got == top


def test_mix(spark, docs, none):
    out = source_mix.mix(spark, docs).collect()
    size = {}
    for i, t, s in pairs():
        size.setdefault(s, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    order = sorted((s for s in size if s is not None)) + [None]
    total, cap = sum(map(sum, size.values())), {s: 3.0 * sum(v) for s, v in size.items()}
    weight, full = {s: 1 + k % 3 for k, s in enumerate(order)}, {}
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > cap[s]]
        if not over:
            break
        full |= {s: cap[s] for s in over}
    target = {s: full.get(s, level * weight[s]) for s in order}
    source = defaultdict(list)
    for i, t, s in pairs():
        source[i].append(s)
    taken = Counter()
    for r in out:
        assert r.taken <= 3 * r.size
        s = source[r.doc_id][0]
        assert r.target == pytest.approx(target[s]) and r.source_size == sum(size[s])
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(2 * source_mix.BLOCK_WORDS, 0.02 * target[s])
    assert Counter(out) == Counter(source_mix.mix(spark, docs).collect())
    assert source_mix.mix(spark, none).count() == 0
    assert source_mix.mixed(spark, docs).columns == docs.columns


def test_sainte_lague_is_by_highest_quotients(spark):
    votes = [(k, float(v)) for k, v in enumerate([53000, 24000, 23000, 10, 0, 777])]
    for seats in (1, 2, 7, 100):
        x = spark.createDataFrame([(1, k, v, seats) for k, v in votes], "g int, k int, v double, seats int")
        got = {r.k: r.quota for r in source_mix.sainte_lague(x, ["g"], "seats", "v", "k").collect()}
        best = Counter(k for _, k in sorted((-v / (2 * j + 1), k) for k, v in votes if v for j in range(seats))[:seats])
        assert got == {k: best[k] for k, _ in votes}


def test_licenses(spark, docs, none):
    out = {(r.doc_id, r.n_words): r for r in license_diagonal.scan(spark, docs)[0].collect()}
    for i, t, _ in pairs():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
        at = [(k, name) for name, p in license_diagonal.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = out[i, len(w)]
        assert (r.n_base, r.base_labels) == (len(at), ",".join(sorted({n for _, n in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None)) and 0 <= r.score <= 1
    assert license_diagonal.scan(spark, none)[0].count() == 0


def test_license_notice_with_changes(spark):
    words = license_diagonal.NOTICES[0][1].split()
    changed = words[:8] + ["really"] + words[8:20] + words[21:]
    r = license_diagonal.scan(spark, spark.createDataFrame([(1, "Hi " + " ".join(changed).upper())], "doc_id long, text string"))[0].first()
    assert r.labels == "mit" and r.base_labels == "" and r.n_base == 0 and r.score > 0.75


def test_sentencepiece(spark, docs, none):
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    out = sp.encode(spark, docs)
    text = defaultdict(list)
    for r in rows():
        text[r[0]].append(r[1])
    for r in out.collect():
        t = text[r.doc_id][0]
        assert r.ids == (None if t is None else ref.encode(t))
        assert r.exact is None if t is None else r.exact == ("▁" not in t)
    back = {r.doc_id: r.text for r in sp.decode(spark, out).collect()}
    assert all(back[i] == (None if t[0] is None else t[0].replace("▁", " ")) for i, t in text.items())
    assert sp.encode(spark, none).count() == 0


def test_sentencepiece_random():
    import random

    import sentencepiece

    ref, fst, rng = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL), sp.Transducer(sp.load(sp.MODEL)), random.Random(3)
    for _ in range(1500):
        t = "".join(fst.names[rng.randrange(259, len(fst.names))].replace("▁", " ") for _ in range(rng.randrange(8))) + rng.choice(["", " " * rng.randrange(20), "\n\t", chr(rng.randrange(32, 0x3000))])
        assert fst.encode(t).tolist() == ref.encode(t) and fst.decode(fst.encode(t)) == t.replace("▁", " ")


def test_unigram_paths():
    pieces = [("<unk>", 0.0, "control"), *((f"<0x{b:02X}>", -20.0, "byte") for b in range(256)), ("▁", -2.0, "normal"), ("a", -3.0, "normal"), ("b", -3.0, "normal"), ("ab", -4.0, "normal"), ("▁a", -2.5, "normal"), ("ba", -3.5, "normal")]
    fst = sp.Transducer({"bpe": False, "prefix": True, "pieces": pieces})

    def best(s):
        if not s:
            return (0.0, ())
        return min((w - fst.score[k] + 0.0, (k, *rest)) for p, k in fst.ids.items() if s.startswith(p) for w, rest in [best(s[len(p) :])])

    for t in ("ab", "aba", "abab", "bba", "aabb"):
        assert sum(-fst.score[k] for k in fst.encode(t)) == pytest.approx(best("▁" + t)[0])


def test_queries_have_contract_columns():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)}

"""Rows that repeat an id with other contents: n-gram join and embedding near-dedup against brute force."""

import numpy as np

from ionflow.llm import embedding_forest as ef, ngram_join


def _components(nodes, links):
    low = {k: k for k in nodes}
    while True:
        old = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == old:
            return low


def _ngram_brute(rows):
    """(component by document, sizes in order of rows) by comparing all texts."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return _components({k for k, _ in rows}, links), [len(s) for s in sets]


def test_ngram_links_of_each_text_of_a_document(spark):
    t, u = (" ".join(f"{x}{k}" for k in range(60)) for x in "tu")
    rows = [(5, t), (5, u), (3, u), (7, t.rsplit(" ", 1)[0] + " end")]
    got = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert len(got) == 4 and {r.component_id for r in got} == {3}


def test_ngram_repeated_documents_against_brute_force(spark):
    rng = np.random.default_rng(5)
    bases = [" ".join(f"b{b}w{k}" for k in range(50)) for b in range(25)]
    texts = []
    for _ in range(260):
        w = bases[rng.integers(25)].split()
        for k in rng.integers(0, 50, rng.integers(0, 3)):
            w[k] = f"x{rng.integers(40)}"
        texts.append(" ".join(w))
    ids = np.arange(260)
    again = rng.random(260) < 0.33
    ids[again] = rng.integers(0, 260, int(again.sum()))
    rows = [(int(k), t) for k, t in zip(ids, texts)] + [(0, None), (1, "one two"), (2, "one two")]
    rows += rows[:7]
    want, sizes = _ngram_brute(rows)
    got = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5))[0].collect()
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((k, n) for (k, _), n in zip(rows, sizes))
    assert all(r.component_id == want[r.doc_id] for r in got)


def test_vectors_that_share_an_id(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, 1), (5, b, 1), (9, a, 1), (12, [0.0, 1.0, 0.05], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in ef.near_dedup(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))[0].collect()}
    assert got == {5: (2, 5), 9: (1, 5), 12: (1, 5)}


def test_repeated_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = []
    for k in range(300):
        v = base[rng.integers(30)] + rng.normal(size=16) * rng.choice([0.0, 0.03, 0.2])
        rows.append((int(k if rng.random() > 0.33 else rng.integers(300)), v.tolist(), int(rng.integers(2))))
    rows += rows[:9]
    one = sorted({(i, label, tuple(v)) for i, v, label in rows})
    x = np.array([v for _, _, v in one])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.98
    links, counts = [], dict.fromkeys({i for i, _, _ in one}, 0)
    for p in range(len(one)):
        for q in range(len(one)):
            if p != q and near[p, q] and one[p][1] == one[q][1]:
                links.append((one[p][0], one[q][0]))
                counts[one[p][0]] += 1
    low = _components(counts, links)
    got = ef.near_dedup(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4))[0].collect()
    assert len(got) == len(rows)
    assert all((r.n_links, r.component_id, r.kept) == (counts[r.vec_id], low[r.vec_id], r.vec_id == low[r.vec_id]) for r in got)

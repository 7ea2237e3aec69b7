"""Toxicity: a linear-chain CRF over words, whose marginals make a document's score.

Words of labelled documents get token labels: toxic where the document is
labelled toxic and the word or its beginning occurs in toxic documents far
more often than chance allows; where a toxic document has no such word, as with
few labels or in a rare language, its words of most evidence are taken. A CRF
with two states and hashed word and word-beginning features is trained on these sequences by gradient descent of
the exact likelihood (forward-backward). For every text, forward-backward
gives each word's probability of being toxic; these are aggregated into a
score, calibrated on the training documents, and into offending offsets.

Bounded: training uses at most MAX_TOXIC and MAX_CLEAN labelled documents of at
most MAX_CHARS characters each, chosen by a hash of doc_id, near copies left
out. Scoring covers every text whole. Neither labels nor lang, source or
doc_id are inputs of a score.

Null and empty texts have no words and get the lowest score. Labels that are
null or contradict each other are not used; without a label of each kind every
score is 0. Rows that repeat a doc_id are scored each by its own text; a null
doc_id is not held out. Other columns are ignored (score) or kept (keep_clean);
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ionflow.llm import common, textvec

MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 4500, 6000
THRESHOLD = 0.7
#: Byte lengths of word beginnings used as features, besides the word itself.
PREFIXES = (4, 5, 6)
#: Values of the features of a word: short beginnings, which many words share, say less.
VALUES = np.array([1.0, 0.4, 0.6, 0.8])
HASH_LOG2 = 18
STEPS, RATE, L2 = 40, 0.5, 1e-4
#: Evidence, in nats, that a word goes with toxic documents, at which its tokens are labelled in all of them.
EVIDENCE = 10.0
#: Where no word of a toxic document has it: the share of its best word's evidence, and as many documents, that a word needs at the least.
SHARE, LEAST = 0.7, 1.99
# These three were chosen by two-fold cross-validation over labelled rows of remainder 0 and 2, never by held-out ones.
#: Words handled at once by forward-backward; a longer text alone may be more.
GROUP = 1 << 20
_KINDS = 1 + len(PREFIXES)


def _index(h: np.ndarray) -> np.ndarray:
    """Feature numbers of words: one for each kind."""
    return (h >> np.uint64(64 - HASH_LOG2)).astype(np.int32) + (np.arange(_KINDS, dtype=np.int32) << HASH_LOG2)


class Chains:
    """Sequences side by side, longest first, so that one numpy step advances all of them."""

    def __init__(self, counts: np.ndarray):
        self.rank = np.argsort(np.argsort(-counts, kind="stable"), kind="stable")
        longest = int(counts.max()) if len(counts) else 0
        self.active = len(counts) - np.searchsorted(np.sort(counts), np.arange(longest), "right")
        self.offs = np.concatenate([[0], np.cumsum(self.active)])
        row = np.repeat(np.arange(len(counts)), counts)
        t = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        self.place = self.offs[t] + self.rank[row] if len(t) else np.zeros(0, np.int64)

    def run(self, e: np.ndarray, trans: np.ndarray):
        """e: log-odds of state 1 by word, in document order. Marginals in that order, and what gradients need."""
        psi = np.empty(len(e))
        psi[self.place] = np.exp(np.clip(e, -30, 30))
        m = np.exp(trans)
        f = np.empty(len(e))  # filtered probability of state 1
        n = len(self.active)
        for t in range(n):
            a, b = self.offs[t], self.offs[t + 1]
            if t:
                p = f[self.offs[t - 1] : self.offs[t - 1] + (b - a)]
                x1 = (m[0, 1] + p * (m[1, 1] - m[0, 1])) * psi[a:b]
                x0 = m[0, 0] + p * (m[1, 0] - m[0, 0])
            else:
                x1, x0 = psi[a:b], 1.0
            f[a:b] = x1 / (x0 + x1)
        g = np.full(len(e), 0.5)  # backward message for state 1, scaled to sum to 1
        for t in range(n - 2, -1, -1):
            a, b, k = self.offs[t], self.offs[t + 1], self.active[t + 1]
            q = g[b : b + k]
            w1, w0 = psi[b : b + k] * q, 1 - q
            y1, y0 = m[1, 0] * w0 + m[1, 1] * w1, m[0, 0] * w0 + m[0, 1] * w1
            g[a : a + k] = y1 / (y0 + y1)
        top = f * g
        p = top / (top + (1 - f) * (1 - g))
        return p[self.place], (psi, f, g, m)

    def pairs(self, state) -> np.ndarray:
        """Expected transitions, 2 x 2."""
        psi, f, g, m = state
        out = np.zeros((2, 2))
        for t in range(1, len(self.active)):
            a, b = self.offs[t], self.offs[t + 1]
            p = f[self.offs[t - 1] : self.offs[t - 1] + (b - a)]
            w1, w0 = psi[a:b] * g[a:b], 1 - g[a:b]
            x = np.array([[m[0, 0] * (1 - p) * w0, m[0, 1] * (1 - p) * w1], [m[1, 0] * p * w0, m[1, 1] * p * w1]])
            out += (x / x.sum(axis=(0, 1))).sum(axis=2)
        return out


def _evidence(f: np.ndarray, docs: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """By feature: nats by which its documents are toxic more often than documents at large."""
    size = _KINDS << HASH_LOG2
    n, a = np.zeros(size), np.zeros(size)
    for k in range(_KINDS):  # one kind at a time, to keep the driver small
        cell = np.unique(f[:, k].astype(np.int64) * len(toxic) + docs)
        by = cell // len(toxic)
        n += np.bincount(by, minlength=size)
        a += np.bincount(by, toxic[cell % len(toxic)], minlength=size)
    q = toxic.mean()
    r = a / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(r > 0, r * np.log(r / q), 0) + np.where(r < 1, (1 - r) * np.log((1 - r) / (1 - q)), 0)
    return np.where(r > max(0.9, q), n * kl, 0.0)


def _labels(f: np.ndarray, docs: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Of each word: whether its token is labelled toxic."""
    by = _evidence(f, docs, toxic)
    best = np.maximum.reduce([by[f[:, k]] for k in range(_KINDS)]) * toxic[docs]
    most = np.zeros(len(toxic))
    np.maximum.at(most, docs, best)
    # a toxic document without a word of full evidence has its words of most evidence labelled
    return best >= np.clip(SHARE * most, LEAST * -np.log(toxic.mean()), EVIDENCE)[docs]


def train(texts: pa.Array, toxic: np.ndarray) -> dict:
    """A model from texts and their labels: feature weights, transitions, calibration."""
    size = _KINDS << HASH_LOG2
    none = {"w": None, "trans": np.zeros((2, 2)), "cal": np.zeros(3)}
    # near copies would pass off all their words as typical: one of them is enough
    keep, seen = np.zeros(len(toxic), bool), [set(), set(), set()]
    for i, j, words, counts, _, _ in textvec.WordHasher(textvec.ALNUM).batches(texts):
        v, r = textvec.shingles(words, counts)
        for k in range(i, j):
            own = v[r == k - i]
            if len(own):
                low = [int(textvec.mix(own + np.uint64(s)).min()) for s in (1, 2, 3)]
                keep[k] = not any(x in s for x, s in zip(low, seen))
                for x, s in zip(low, seen):
                    s.add(x)
    texts, toxic = texts.filter(pa.array(keep)), toxic[keep].astype(bool)
    if not toxic.any() or toxic.all():
        return none
    parts = [(h, c) for _, _, h, c, _, _ in textvec.WordHasher(textvec.ALNUM, PREFIXES).batches(texts)]
    f, counts = np.asfortranarray(np.concatenate([_index(h) for h, _ in parts])), np.concatenate([c for _, c in parts])
    del parts
    docs = np.repeat(np.arange(len(counts)), counts)
    y = _labels(f, docs, toxic)
    if not y.any():
        return none
    chains = Chains(counts)
    w, trans = np.zeros(size), np.zeros((2, 2))
    w_sum, t_sum = np.full(size, 1e-6), np.full((2, 2), 1e-6)
    follow = docs[1:] == docs[:-1]
    seen2 = np.bincount(2 * y[:-1][follow] + y[1:][follow], minlength=4).reshape(2, 2).astype(float)
    first = sum(VALUES[k] * np.bincount(f[y, k], minlength=size) for k in range(_KINDS))

    def sums() -> np.ndarray:
        return sum(VALUES[k] * w[f[:, k]] for k in range(_KINDS)) + bias

    n = float(y.sum())
    bias, b_sum = 0.0, 1e-6
    for step in range(STEPS):
        p, state = chains.run(sums(), trans)
        grad = (first - sum(VALUES[k] * np.bincount(f[:, k], p, minlength=size) for k in range(_KINDS))) / n - L2 * w
        w_sum += grad**2
        w += RATE * grad / np.sqrt(w_sum)
        grad_b = (n - p.sum()) / n
        b_sum += grad_b**2
        bias += RATE * grad_b / np.sqrt(b_sum)
        grad = (seen2 - chains.pairs(state)) / n - L2 * trans
        t_sum += grad**2
        trans += RATE * grad / np.sqrt(t_sum)
    p, _ = chains.run(sums(), trans)
    x = _aggregate(p, counts)
    cal = np.zeros(3)
    for _ in range(50):  # Newton steps of a logistic regression with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ cal, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3)
        cal += np.clip(np.linalg.solve(h, x.T @ (toxic - q) - 1e-2 * cal), -2, 2)
    w *= np.repeat(VALUES, 1 << HASH_LOG2)  # the values go into the weights
    return {"w": w.astype(np.float32), "bias": bias, "trans": trans, "cal": cal}


def _aggregate(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each document: the log of the toxic words expected among offending ones, the logit of the largest marginal."""
    x = np.zeros((len(counts), 3))
    x[:, 0] = 1
    full = counts > 0
    starts = (np.cumsum(counts) - counts)[full]
    mass, top = np.zeros(len(counts)), np.full(len(counts), 1e-6)
    if full.any():
        mass[full] = np.add.reduceat(np.where(p >= 0.5, p, 0.0), starts)
        top[full] = np.clip(np.maximum.reduceat(p, starts), 1e-6, 1 - 1e-6)
    x[:, 1] = np.log(0.05 + mass)
    x[:, 2] = np.log(top / (1 - top)) / 6
    return x


def _scorer(model: dict):
    w, trans, cal = model["w"], model["trans"], model["cal"]

    def tag(texts: pa.Array, base: int, parts: list, out_score: list, out_spans: list) -> None:
        counts = np.concatenate([c for _, c, _, _ in parts])
        chains = Chains(counts)
        p, _ = chains.run(np.concatenate([e for e, _, _, _ in parts]).astype(np.float64), trans)
        x = _aggregate(p, counts)
        out_score.append(1 / (1 + np.exp(-np.clip(x @ cal, -30, 30))))
        start, length = np.concatenate([s for _, _, s, _ in parts]), np.concatenate([z for _, _, _, z in parts])
        docs = np.repeat(np.arange(len(counts)), counts)
        spans: dict[int, list] = {}
        hot = np.flatnonzero(p >= 0.5)
        for k in hot.tolist():
            own = spans.setdefault(int(docs[k]), [])
            a, b = int(start[k]), int(start[k] + length[k])
            if own and own[-1][2] == k - 1:
                own[-1][1:] = [b, k]
            else:
                own.append([a, b, k])
        for d in range(len(counts)):
            if d in spans:
                raw = texts[base + d].as_py().encode()
                cuts, at, n = [], 0, 0
                for a, b, _ in spans[d]:
                    n += len(raw[at:a].decode(errors="replace"))
                    s = n
                    n += len(raw[a:b].decode(errors="replace"))
                    at = b
                    cuts.append({"start": s, "end": n})
                out_spans.append(cuts)
            else:
                out_spans.append([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = textvec.WordHasher(textvec.ALNUM, PREFIXES)
        for b in batches:
            texts = b.column(1).fill_null("")
            score, spans, parts, words, base = [], [], [], 0, 0
            if w is None:
                score, spans = [np.zeros(b.num_rows)], [[] for _ in range(b.num_rows)]
            else:
                for _, j, h, counts, s, z in hasher.batches(texts):
                    parts.append((w[_index(h)].sum(axis=1) + np.float32(model["bias"]), counts, s, z))
                    words += len(h)
                    if words >= GROUP or j == b.num_rows:
                        tag(texts, base, parts, score, spans)
                        parts, words, base = [], 0, j
            score = np.concatenate(score) if score else np.zeros(0)
            spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.record_batch([b.column(0), pa.array(score), spans], names=["key", "score", "spans"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> dict:
    """The model, from rows that are not held out."""
    own = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic")
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    # ids of three times as many rows as are used, since the long ones fall away
    some = own.where("toxic = 1").orderBy(order, "doc_id").limit(3 * MAX_TOXIC).union(own.where("toxic = 0").orderBy(order, "doc_id").limit(3 * MAX_CLEAN))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= MAX_CHARS).join(F.broadcast(some), "doc_id")
    rows = texts.where("toxic = 1").orderBy(order, "doc_id", "text").limit(MAX_TOXIC).union(texts.where("toxic = 0").orderBy(order, "doc_id", "text").limit(MAX_CLEAN)).select("doc_id", "text", "toxic").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(rows.column("text").combine_chunks().cast(pa.string()), rows.column("toxic").to_numpy().astype(np.int64))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for each row; spans: offending code point offsets."""
    common.ship(spark)
    model = fit(spark, docs, labels) if model is None else model
    out = docs.select(F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(_scorer(model), f"key {docs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int>>")
    return out.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the texts predicted toxic; scored in place, no join."""
    common.ship(spark)
    model = fit(spark, docs, labels)
    run = _scorer(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            two = pa.record_batch([b.column(0), b.column(b.schema.get_field_index("text"))], names=["key", "text"])
            for s in run(iter([two])):
                yield b.filter(pa.array(s.column("score").to_numpy() < THRESHOLD))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(keep, docs.withColumn("text", F.col("text").cast("string")).schema)

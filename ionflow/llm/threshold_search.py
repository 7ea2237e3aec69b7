"""Ranked lexical search by Fagin's threshold algorithm over document-partitioned blocks.

1. A forward index is written: of each document its length and the items'
   terms it holds, with their frequencies; the corpus counts N, L and df come
   from all documents in the same pass.
2. Each task takes its documents in blocks. A block has, for each term, a list
   of its documents by falling impact, and a forward index for random lookups.
   For each item the lists are read round-robin to equal depths; documents met
   for the first time are looked up and scored in full. The threshold, the sum
   of the impacts read last, bounds the score of all documents not yet met: once
   it is strictly below the kth score the block is done, equal scores being
   settled by doc_id. The best k of earlier blocks of a task stay, so that
   later blocks stop sooner.
3. The best k of each task are merged in two steps.

Items are taken in batches of about BATCH_TERMS terms by a hash of the item, so
that what a task holds is bounded, however many items there are; each batch
reads the documents once.

Nulls and rows: a null text has no terms. Rows that repeat a doc_id are
documents of their own, each counted and ranked; a null doc_id ranks after
others of equal score. Rows that repeat an item_id are one item that has the
terms of each. Very long texts are read whole, in pieces cut between words.
Items without terms or hits, and empty tables, give no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ionflow.llm import common, textvec

TOP = 10
#: Terms of a batch of items, in expectation.
BATCH_TERMS = 8192
#: Documents of a block, and entries of its forward index (documents times terms).
BLOCK_DOCS, BLOCK_CELLS = 2048, 1 << 23
#: Entries of each list that are read first; then as many again.
FIRST_DEPTH = 16
_NO_ID = np.int64(2**63 - 1)
#: Groups that the bests of tasks are merged in first.
_LANES = 64


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, hashes of terms, terms per row)."""
    for i, j, h, counts, _, _ in textvec.WordHasher(textvec.ALNUM).batches(column):
        yield i, j, h, counts


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, h, counts in _words(b.column(1)):
            rows = pa.array(np.repeat(np.arange(i, j), counts))
            yield pa.record_batch([b.column(0).take(rows), pa.array(h.view(np.int64))], names=["item_id", "term"])


class Queries:
    """The items of a batch: sorted hashes of their terms, and each item's terms with multiplicities."""

    def __init__(self, rows: list):
        self.terms = np.unique(np.array([r.term for r in rows], np.int64).view(np.uint64))
        ids: dict = {}
        for r in rows:
            ids.setdefault(r.item_id, []).append((np.uint64(r.term % 2**64), r.times))
        self.items = sorted(ids, key=lambda k: (k is None, k))
        self.parts = []
        for k in self.items:
            own = np.searchsorted(self.terms, np.array([t for t, _ in ids[k]], np.uint64))
            self.parts.append((own, np.array([m for _, m in ids[k]], np.int64)))


def _forward(terms: np.ndarray):
    """Forward index rows, and at the end of a task its df of each term."""
    names = ["doc_id", "n", "terms", "tfs", "df"]

    def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, v = np.zeros(len(terms), np.int64), len(terms)
        for b in batches:
            for i, j, h, counts in _words(b.column(1)):
                at = np.minimum(np.searchsorted(terms, h), v - 1)
                hit = terms[at] == h
                rows = np.repeat(np.arange(j - i), counts)[hit]
                key, tf = np.unique(rows * v + at[hit], return_counts=True)
                df += np.bincount(key % v, minlength=v)
                ends = np.concatenate([[0], np.cumsum(np.bincount(key // v, minlength=j - i))])
                out = pa.record_batch([b.column(0).slice(i, j - i), pa.array(counts.astype(np.int64)), packed(key % v, ends), packed(tf, ends), pa.nulls(j - i, pa.int64())], names=names)
                yield out.filter(pa.array(counts > 0))
        own = np.flatnonzero(df)
        if len(own):
            yield pa.record_batch([pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64()), packed(own, np.arange(len(own) + 1)), packed(np.zeros(0, int), np.zeros(len(own) + 1, int)), pa.array(df[own])], names=names)

    return run


class Block:
    """Documents with impact-sorted lists and a forward index of quotients, by terms that occur in the block."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, quotient: np.ndarray, vocabulary: int):
        self.ids = ids
        own, at = np.unique(term, return_inverse=True)
        self.place = np.full(vocabulary, -1, np.int64)
        self.place[own] = np.arange(len(own))
        self.forward = np.zeros((len(ids), len(own)), np.int32)
        self.forward[doc, at] = quotient
        # by term, falling quotient, document
        by = np.lexsort((doc, -quotient, at))
        self.docs, self.quotients = doc[by], quotient[by]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(own)))])

    def search(self, terms: np.ndarray, factor: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """best (scores, ids: the best k so far, best first) with this block's documents, and how many were looked up.

        factor: of each term its weight times how often the item has it.
        """
        own = self.place[terms]
        own, factor = own[own >= 0], factor[own >= 0]
        seen, looked = np.zeros(len(self.ids), bool), 0
        start, size = self.start[own], self.start[own + 1] - self.start[own]
        depth, step = 0, FIRST_DEPTH
        while len(own) and depth < size.max():
            # the next entries of each list, round-robin to equal depth
            at = depth + np.arange(step)
            inside = at < size[:, None]
            met = self.docs[(start[:, None] + at)[inside]]
            new = np.unique(met[~seen[met]])
            seen[new] = True
            looked += len(new)
            score = self.forward[np.ix_(new, own)].astype(np.int64) @ factor
            if len(best[0]) == k:
                new, score = new[score >= best[0][-1]], score[score >= best[0][-1]]
            new, score = new[score > 0], score[score > 0]
            if len(new):
                scores, ids = np.concatenate([best[0], score]), np.concatenate([best[1], self.ids[new]])
                by = np.lexsort((ids, -scores))[:k]
                best = scores[by], ids[by]
            depth, step = depth + step, depth + step
            # documents not met have at most what was read last of each list; of a list read to its end, nothing
            last = np.where(depth < size, self.quotients[np.minimum(start + depth, self.start[own + 1]) - 1], 0)
            if len(best[0]) == k and int(last @ factor) < best[0][-1]:
                break
        return best, looked


def _search(queries: Queries, weights: np.ndarray, total: int, length: int, k: int):
    v = len(queries.terms)
    factors = [weights[own] * times for own, times in queries.parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.items]
        held: list[tuple] = []

        def full() -> None:
            ids, sizes, terms, quotients = (np.concatenate(x) for x in zip(*held))
            held.clear()
            block = Block(ids, np.repeat(np.arange(len(ids)), sizes), terms, quotients, v)
            for q, (own, _) in enumerate(queries.parts):
                best[q], _ = block.search(own, factors[q], best[q], k)

        most = max(1, min(BLOCK_DOCS, BLOCK_CELLS // max(1, v)))
        for b in batches:
            for lo in range(0, b.num_rows, most):
                part = b.slice(lo, most)
                ids = part.column("doc_id").fill_null(int(_NO_ID)).to_numpy()
                n = part.column("n").to_numpy()
                sizes = np.diff(part.column("terms").offsets.to_numpy())
                terms, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
                m = np.repeat(25 + 75 * n * total // length, sizes)
                held.append((ids, sizes, terms, 1_000_000_000 * tf // (1000 * tf + 8 * m)))
                if sum(len(x[0]) for x in held) >= most:
                    full()
        if held:
            full()
        for q, (scores, ids) in enumerate(best):
            if len(ids):
                yield pa.record_batch([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], names=["q", "doc_id", "score"])

    return run


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, equal scores by doc_id."""
    common.ship(spark)
    base = common.workdir(spark, "search")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    terms = items.mapInArrow(_item_terms, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("times"))
    terms = common.saved(terms, f"{base}/terms")
    parts = -(-terms.count() // BATCH_TERMS)
    out = None
    for p in range(parts):
        # one batch's terms, some thousands
        queries = Queries(terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).collect())
        if queries.items:
            found = _batch(spark, docs, queries, k, f"{base}/{p}")
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def _batch(spark: SparkSession, docs: DataFrame, queries: Queries, k: int, base: str) -> DataFrame:
    with common.arrow_rows(spark, 1000):
        index = common.saved(docs.mapInArrow(_forward(queries.terms), "doc_id long, n long, terms array<int>, tfs array<int>, df long"), f"{base}/forward")
    rows = index.where("df is null").drop("df")
    total, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(queries.terms), np.int64)
    for t, df in index.where("df is not null").groupBy(F.col("terms")[0].alias("t")).agg(F.sum("df")).collect():  # a row a term of the batch
        weights[t] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
    with common.arrow_rows(spark, 2048):
        best = common.saved(rows.mapInArrow(_search(queries, weights, total, length, k), "q int, doc_id long, score long"), f"{base}/best")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    lane = best.withColumn("lane", F.pmod(F.xxhash64("doc_id"), F.lit(_LANES)))
    few = lane.withColumn("rank", F.row_number().over(W.partitionBy("q", "lane").orderBy(*order))).where(F.col("rank") <= k)
    top = few.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(queries.items)), "q int, item_id long")
    return top.join(names, "q").select("item_id", "rank", "doc_id", "score")

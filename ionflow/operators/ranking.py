"""Order of candidates: baseline, mass only, learned; ranks of the truth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ionflow.functions.hashing import seed_for
from ionflow.operators.features import FEATURES
from ionflow.sources import tables

def _molecule():
    return W.partitionBy("molecule_id")


def baseline(cands: DataFrame) -> DataFrame:
    """rank and score (n, n - 1, ..., 1) by support, explained intensity, mass error and formula."""
    by = _molecule().orderBy(F.desc("support"), F.desc(F.round("intensity_fraction_mean", 9)), F.round("mean_abs_ppm", 9), "formula")
    out = cands.withColumn("rank", F.row_number().over(by))
    return out.withColumn("score", (F.count("*").over(_molecule()) - F.col("rank") + 1).cast("double"))


def baseline_lists(molecules: DataFrame) -> DataFrame:
    """The order of baseline for molecules with cands and evidence (features.of_lists): ranked has the candidates, the first of rank 1.

    Of a candidate ranked has the formula, and all of it as cand; no row of a candidate is shuffled.
    """
    def key(z: Column) -> Column:
        c, e = z["cands"], z["evidence"]
        return F.struct((-c["support"]).alias("a"), (-F.round(e["intensity_fraction_mean"], 9)).alias("b"), F.round(c["mean_abs_ppm"], 9).alias("c"), c["formula"].alias("formula"), c.alias("cand"))

    return molecules.withColumn("ranked", F.array_sort(F.transform(F.arrays_zip("cands", "evidence"), key))).drop("cands", "evidence")


def mass_only(cands: DataFrame) -> DataFrame:
    return cands.withColumn("rank", F.row_number().over(_molecule().orderBy(F.desc("support"), F.round("mean_abs_ppm", 9), "formula")))


def by_score(cands: DataFrame, score: str = "score") -> DataFrame:
    return cands.withColumn("rank", F.row_number().over(_molecule().orderBy(F.desc(score), "formula")))


def rank_of_target(rows: DataFrame, group: str, score: str, label: str, order: str) -> DataFrame:
    """Rank of each group's labelled row without a sort: one and how many score more, or the same and come before."""
    t = rows.where(F.col(label) == 1).select(group, F.col(score).alias("__s"), F.col(order).alias("__o"))
    ahead = (F.col(score) > F.col("__s")) | ((F.col(score) == F.col("__s")) & (F.col(order) < F.col("__o")))
    return rows.join(t, group).groupBy(group).agg((1 + F.count_if(ahead)).alias("rank"))


def truth_rank(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """(molecule_id, formula, rank) of each truth; rank null where it is no candidate."""
    return truth.join(ranked.select("molecule_id", "formula", "rank"), ["molecule_id", "formula"], "left")


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def training_rows(ranked: DataFrame, truth: DataFrame, seed: int, hard: int = 127, others: int = 128) -> DataFrame:
    """Rows to learn from: the truth if it was found, the best hard others, and some drawn of the rest.

    Molecules whose truth is no candidate, or is the only one, give none. A
    molecule's rows (capped candidates) are one group; each has its own seed.
    """
    tables.ship(ranked.sparkSession)
    x = ranked.join(truth.select("molecule_id", F.col("formula").alias("truth")), "molecule_id").withColumn("label", (F.col("formula") == F.col("truth")).cast("int"))
    ok = x.groupBy("molecule_id").agg(F.max("label").alias("has"), F.count("*").alias("n")).where("has = 1 and n > 1").select("molecule_id")
    x = x.join(ok, "molecule_id", "left_semi").drop("truth")
    shape = x.schema

    def pick(table):
        rank = np.argsort(np.asarray(table.column("rank").to_pylist()), kind="stable")
        label = np.asarray(table.column("label").to_pylist())
        wrong = rank[label[rank] == 0]
        rest = wrong[hard:]
        rng = np.random.default_rng(seed_for(f"{seed}:{table.column('molecule_id')[0].as_py()}"))
        some = rng.choice(rest, size=min(others, len(rest)), replace=False) if len(rest) else rest
        return table.take(pa.array(np.concatenate([np.flatnonzero(label == 1)[:1], wrong[:hard], some]).astype(np.int64)))

    return x.groupBy("molecule_id").applyInArrow(pick, shape)


def training_lists(molecules: DataFrame, lists: DataFrame, seed: int, hard: int = 127, others: int = 128) -> DataFrame:
    """As training_rows, in the order of mass_only, which is that of lists: molecules (molecule_id, like, truth) with candidates.lists.

    (molecule_id, formula, rank, label). What is drawn depends on how many there
    are and on the molecule; only where some are left out a task draws.
    """
    tables.ship(lists.sparkSession)
    formulas = lists.select("like", F.transform("cands", lambda c: c["formula"]).alias("formulas"))
    x = molecules.select("molecule_id", "like", "truth").join(formulas, "like").drop("like")
    at = F.array_position("formulas", F.col("truth")).cast("int")
    x = x.withColumn("at", at).where("at > 0 and size(formulas) > 1").drop("truth")

    def draw(batches):
        for b in batches:
            ids, n, at = (b.column(c).to_pylist() for c in ("molecule_id", "n", "at"))
            kept = []
            for molecule, k, own in zip(ids, n, at):
                wrong = np.delete(np.arange(1, k + 1), own - 1)
                rest = wrong[hard:]
                some = np.random.default_rng(seed_for(f"{seed}:{molecule}")).choice(rest, size=min(others, len(rest)), replace=False)
                kept.append(np.concatenate([[own], wrong[:hard], some]).astype(np.int32))
            yield pa.record_batch([*b.columns, pa.array(kept, pa.list_(pa.int32()))], names=[*b.schema.names, "kept"])

    few = x.where(F.size("formulas") <= 1 + hard + others).withColumn("kept", F.sequence(F.lit(1), F.size("formulas")))
    many = x.where(F.size("formulas") > 1 + hard + others).withColumn("n", F.size("formulas"))
    many = many.mapInArrow(draw, T.StructType([*many.schema, T.StructField("kept", T.ArrayType(T.IntegerType()))])).drop("n")
    x = few.unionByName(many).select("molecule_id", "at", "formulas", F.explode("kept").alias("rank"))
    return x.select("molecule_id", F.element_at("formulas", F.col("rank")).alias("formula"), "rank", (F.col("rank") == F.col("at")).cast("int").alias("label"))


class Tree:
    """A regression tree over binned features, as flat arrays; gain of each split and rows of each node as it was grown."""

    def __init__(self, feature, threshold, left, right, value, gain=None, cover=None):
        none = np.zeros(len(feature))
        self.feature, self.threshold, self.left, self.right, self.value = (np.asarray(a) for a in (feature, threshold, left, right, value))
        self.gain, self.cover = (none if a is None else np.asarray(a, float) for a in (gain, cover))

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = self.feature[node] >= 0
            if not inner.any():
                return self.value[node]
            rows = np.flatnonzero(inner)
            n = node[rows]
            go = x[rows, self.feature[n]] <= self.threshold[n]
            node[rows] = np.where(go, self.left[n], self.right[n])

    def to_dict(self) -> dict:
        return {k: getattr(self, k).tolist() for k in ("feature", "threshold", "left", "right", "value", "gain", "cover")}


def _grow(bins, edges, grad, hess, leaves, least, l2, features=None):
    """Best-first growth from gradient histograms; bins: n x f of uint8; features: those that may split, else all."""
    n, f = bins.shape
    width = 64
    feature, threshold, left, right, value, gains, cover = [-1], [0.0], [-1], [-1], [0.0], [0.0], [float(n)]

    def histogram(rows):
        flat = (bins[rows].astype(np.int64) + np.arange(f) * width).ravel()
        g = np.bincount(flat, np.repeat(grad[rows], f), f * width).reshape(f, width)
        h = np.bincount(flat, np.repeat(hess[rows], f), f * width).reshape(f, width)
        c = np.bincount(flat, minlength=f * width).reshape(f, width)
        return g, h, c

    def split(rows):
        g, h, c = (a.cumsum(axis=1) for a in histogram(rows))
        gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
        gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
        gain[(c < least) | (ct - c < least)] = -np.inf
        if features is not None:
            gain[~features] = -np.inf
        at = int(np.argmax(gain))
        return gain.ravel()[at], at // width, at % width

    rows_of = {0: np.arange(n)}
    open_ = {0: split(rows_of[0])}
    while len(rows_of) < leaves and open_:
        node = max(open_, key=lambda k: open_[k][0])
        gain, j, b = open_.pop(node)
        if not gain > 1e-9:
            break
        rows = rows_of.pop(node)
        go = bins[rows, j] <= b
        gains[node] = float(gain)
        feature[node], threshold[node] = j, float(edges[j][b]) if b < len(edges[j]) else np.inf
        for side, part in ((left, rows[go]), (right, rows[~go])):
            side[node] = len(feature)
            rows_of[len(feature)] = part
            open_[len(feature)] = split(part)
            for a, z in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0), (gains, 0.0), (cover, float(len(part)))):
                a.append(z)
    for node, rows in rows_of.items():
        value[node] = -grad[rows].sum() / (hess[rows].sum() + l2)
    return Tree(feature, threshold, left, right, value, gains, cover), rows_of


class Ranker:
    """Gradient-boosted trees on the LambdaRank objective, in numpy."""

    def __init__(self, trees: list[Tree], rate: float, meta: dict | None = None):
        self.trees, self.rate, self.meta = trees, rate, meta or {}

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            out += self.rate * t.predict(x)
        return out

    def to_dict(self) -> dict:
        return {"artifact_version": 1, "features": FEATURES, "rate": self.rate, "meta": self.meta, "trees": [t.to_dict() for t in self.trees]}

    @classmethod
    def from_dict(cls, d: dict) -> Ranker:
        return cls([Tree(**t) for t in d["trees"]], d["rate"], d["meta"])


def mrr(scores: np.ndarray, labels: np.ndarray, sizes: np.ndarray, k: int = 25, groups: int | None = None) -> float:
    """Mean reciprocal rank within k; groups may count those with no rows too."""
    sizes = np.asarray(sizes, np.int64)
    group = np.repeat(np.arange(len(sizes)), sizes)
    start = np.cumsum(sizes) - sizes
    # places after a stable sort by score; the first positive row of a group counts
    place = np.empty(len(group), np.int64)
    place[np.lexsort((-np.asarray(scores), group))] = np.arange(len(group))
    own, first = np.unique(group[np.asarray(labels) != 0], return_index=True)
    rank = place[np.flatnonzero(labels)[first]] - start[own] + 1
    n = len(sizes) if groups is None else groups
    return float((1 / rank[rank <= k]).sum()) / n if n else 0.0


def fit(x, y, sizes, valid=None, weights=None, rounds=1000, leaves=31, rate=0.05, patience=50, least=20, l2=1e-3, valid_groups=None, truncation=None, feature_share=1.0, row_share=1.0, seed=42) -> Ranker:
    """Train on groups of consecutive rows (at most a few hundred each); stop when validation MRR@25 does not rise.

    valid: (x, y, sizes). weights: one a group. truncation: of a pair one must rank
    so high. Each tree sees shares of features and rows drawn by seed.
    """
    if len(sizes) and max(sizes) > 10_000:
        raise ValueError("a group has more than 10000 rows")
    x, y = np.asarray(x, np.float32), np.asarray(y, float)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 64)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    weights = np.ones(len(sizes)) if weights is None else np.asarray(weights, float)
    score, trees, rng = np.zeros(len(x)), [], np.random.default_rng(seed)
    best, best_n, vs = -1.0, 0, None if valid is None else np.zeros(len(valid[0]))
    for _ in range(rounds):
        grad, hess = np.zeros(len(x)), np.full(len(x), 1e-6)
        for g in range(len(sizes)):
            a, b = starts[g], starts[g + 1]
            s, t = score[a:b], np.flatnonzero(y[a:b] > 0)
            if not len(t) or b - a < 2:
                continue
            i = t[0]
            rank = np.empty(b - a)
            rank[np.argsort(-s, kind="stable")] = np.arange(1, b - a + 1)
            gain = np.abs(1 / np.log2(1 + rank[i]) - 1 / np.log2(1 + rank)) * weights[g]
            p = 1 / (1 + np.exp(np.clip(s[i] - s, -30, 30)))
            p[i] = gain[i] = 0.0
            if truncation is not None and rank[i] > truncation:
                gain[rank > truncation] = 0.0
            grad[a:b] += gain * p
            hess[a:b] += gain * p * (1 - p)
            grad[a + i] -= (gain * p).sum()
            hess[a + i] += (gain * p * (1 - p)).sum()
        some = slice(None) if row_share >= 1 else np.sort(rng.choice(len(x), max(1, int(row_share * len(x))), replace=False))
        own = None if feature_share >= 1 else np.isin(np.arange(x.shape[1]), rng.choice(x.shape[1], max(1, int(feature_share * x.shape[1])), replace=False))
        tree, _ = _grow(bins[some], edges, grad[some], hess[some], leaves, min(least, max(1, len(x) // 10)), l2, own)
        score += rate * tree.predict(x)
        trees.append(tree)
        if valid is not None:
            vs += rate * tree.predict(np.asarray(valid[0], np.float32))
            now = mrr(vs, np.asarray(valid[1]), valid[2], groups=valid_groups)
            if now > best + 1e-12:
                best, best_n = now, len(trees)
            elif len(trees) - best_n >= patience:
                break
    if valid is not None:
        trees = trees[:best_n]
    return Ranker(trees, rate, {"validation_mrr25": best, "trees": len(trees)})


def importance(model: Ranker, by: str = "gain") -> list[tuple[str, float]]:
    """Features by the gain of all splits that use them, or by how many these are (by: splits)."""
    total = np.zeros(len(FEATURES))
    for t in model.trees:
        inner = t.feature >= 0
        np.add.at(total, t.feature[inner], t.gain[inner] if by == "gain" else 1.0)
    return sorted(zip(FEATURES, total.tolist()), key=lambda p: (-p[1], p[0]))


class Packed:
    """All trees of a model in one set of flat arrays, walked for all rows and trees at once."""

    def __init__(self, model: Ranker):
        sizes = np.array([len(t.feature) for t in model.trees], np.int64)
        self.roots = np.cumsum(sizes) - sizes
        shift = np.repeat(self.roots, sizes)

        def flat(name: str, kind) -> np.ndarray:
            return np.concatenate([getattr(t, name) for t in model.trees] or [np.zeros(0)]).astype(kind)

        self.feature, self.threshold, self.value = flat("feature", np.int32), flat("threshold", np.float64), flat("value", np.float64)
        self.left, self.right = flat("left", np.int64) + shift, flat("right", np.int64) + shift
        self.rate = model.rate

    def predict(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        out = np.zeros(len(x))
        for lo in range(0, len(x) if len(self.roots) else 0, rows):
            part = x[lo : lo + rows]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            own = np.arange(len(part))[:, None]
            while True:
                feature = self.feature[node]
                inner = feature >= 0
                if not inner.any():
                    break
                go = part[own, np.maximum(feature, 0)] <= self.threshold[node]
                node = np.where(inner, np.where(go, self.left[node], self.right[node]), node)
            # one after the other, as the model adds them up
            for t in range(len(self.roots)):
                out[lo : lo + rows] += self.rate * self.value[node[:, t]]
        return out


def scored(cands: DataFrame, model: Ranker) -> DataFrame:
    """cands with the model's score, in Arrow batches; the packed trees are broadcast once and held by each process."""
    tables.ship(cands.sparkSession)
    names = cands.columns
    # a model has 1000 trees of 31 leaves at most: under 4 MB
    trees = cands.sparkSession.sparkContext.broadcast(Packed(model))

    def run(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], axis=1)
            yield pa.record_batch([*b.columns, pa.array(trees.value.predict(x))], names=[*names, "score"])

    return cands.mapInArrow(run, T.StructType([*cands.schema.fields, T.StructField("score", T.DoubleType())]))

"""Embedding near-dedup by a forest of random-projection trees with spill.

Every tree splits the unit sphere by random hyperplanes at medians, level by
level, until leaves are small; a vector close to a split goes down both sides.
Vectors are compared only within a leaf and label, in double precision; pairs
with a cosine of at least the threshold are links, which join to components.

A leaf returns no pairs but, for each vector, how many links it counted and the
smallest vector its links lead to within the leaf: as many rows as vectors, even
where thousands are near copies of each other. A pair that meets in several
leaves is counted in the first of them only, which both vectors can tell from
the list of leaves that each carries.

The split points and the depth for each label come from a sample of at most
SAMPLE vectors and SAMPLE_BYTES (parameters); all vectors are indexed. Lengths
that the sample lacks are split at 0. Equal vectors of a label are one class,
compared once. A leaf with more than BLOCK vectors, which no split can part, is
compared in pairs of blocks, so that nothing is left out and no task gets more
than two blocks.

Vectors that are null, zero, or hold null or non-finite components, and rows
with a null label or id, link with nothing; vectors of different lengths do
not link with each other. Equal rows count once. Rows that repeat a vec_id with
other contents are vectors of their own that share an id: n_links sums, over the
distinct vectors of the id, the other vectors that each links with, and a
component holds the links of all. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ionflow.llm import common

COSINE = 0.98
TREES = 6
#: Vectors of a leaf and label aimed at, and levels at the least.
LEAF, LEAST_DEPTH = 128, 2
#: Vectors compared with each other in one go.
BLOCK = 1024
#: Bounds of the sample that places the splits.
SAMPLE, SAMPLE_BYTES = 20_000, 1 << 25
#: Margin on either side of a split, as a share of the spread along its direction. Unit vectors with a cosine of
#: COSINE lie 0.2 apart, so their places along a direction differ by a normal variable of 0.2 times the spread: about
#: 1.3 % of such pairs part at a split, 13 % over ten levels, and 5 in a million in all six trees.
SPILL = 0.1
SEED = 7
#: Pairs whose lists of leaves are compared at once.
_PAIRS = 1 << 14


class Forest:
    """Directions and thresholds of all trees for vectors of one length: a direction a level, a threshold a node.

    Nodes that no vector of the sample reaches are split at 0.
    """

    def __init__(self, sample: np.ndarray, dim: int, depth: int, trees: int = TREES, spill: float = SPILL):
        rng = np.random.default_rng((SEED, dim))
        self.trees = []
        for _ in range(trees):
            levels, groups = [], {0: np.arange(len(sample))}
            for _ in range(depth):
                way = rng.standard_normal(dim)
                way /= np.linalg.norm(way)
                p = sample @ way if len(sample) else np.zeros(0)
                cut, nxt = {}, {}
                for node, rows in groups.items():
                    q = p[rows]
                    if len(q) < 2:
                        continue
                    c = float(np.median(q))
                    cut[node] = (c, spill * float(q.std()))
                    nxt[2 * node], nxt[2 * node + 1] = rows[q < c], rows[q >= c]
                nodes = np.array(sorted(cut), np.int64)
                levels.append((way, nodes, np.array([cut[k] for k in nodes.tolist()]).reshape(-1, 2)))
                groups = nxt
            self.trees.append(levels)
        self.usual = np.array([0.0, spill / np.sqrt(dim)])

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(tree, rows, leaves) of unit vectors, each with its own depth; a row may come in several leaves."""
        for t, levels in enumerate(self.trees):
            rows, node = np.arange(len(x)), np.ones(len(x), np.int64)  # a leading one tells levels apart
            for k, (way, nodes, cuts) in enumerate(levels):
                p, goes = (x @ way)[rows], depth[rows] > k
                own = node - (1 << k)
                cut = np.broadcast_to(self.usual, (len(rows), 2))
                if len(nodes):
                    at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
                    cut = np.where((nodes[at] == own)[:, None], cuts[at], cut)
                left, right = goes & (p < cut[:, 0] + cut[:, 1]), goes & (p >= cut[:, 0] - cut[:, 1])
                rows, node = np.concatenate([rows[~goes], rows[left], rows[right]]), np.concatenate([node[~goes], 2 * node[left], 2 * node[right] + 1])
            yield t, rows, node


def _units(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(z.as_buffer(), np.float64) for z in column]


class _Plan:
    """What a task needs to place vectors: the sample by length, and the depth for each label and length."""

    def __init__(self, sample: pa.Table, n: int, trees: int):
        self.trees = trees
        self.by_dim: dict[int, list[np.ndarray]] = {}
        seen: dict[tuple[str, int], int] = {}
        for label, x in zip(sample.column("label").to_pylist(), _units(sample.column("v").combine_chunks())):
            self.by_dim.setdefault(len(x), []).append(x)
            seen[label, len(x)] = seen.get((label, len(x)), 0) + 1
        scale = n / max(1, sample.num_rows)
        # a label that the sample lacks has few vectors, of a whole sample none
        self.depth = {k: self._levels(c * scale) for k, c in seen.items()}
        self.other = self._levels(scale)
        self._forests: dict[int, Forest] = {}

    @staticmethod
    def _levels(n: float) -> int:
        return max(LEAST_DEPTH, int(np.ceil(np.log2(max(1.0, n / LEAF)))))

    def forest(self, dim: int) -> Forest:
        if dim not in self._forests:
            sample = np.stack(self.by_dim[dim]) if dim in self.by_dim else np.zeros((0, dim))
            deepest = max([self.other, *(d for (_, k), d in self.depth.items() if k == dim)])
            self._forests = {dim: Forest(sample, dim, deepest, self.trees)}  # one is kept
        return self._forests[dim]


def _plant(plan: _Plan):
    shape = ["id", "key", "label", "dim", "copies", "code", "codes", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            labels = b.column("label").to_pylist()
            depth = np.array([plan.depth.get((z, d), plan.other) for z, d in zip(labels, dims.tolist())], np.int64)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = np.stack(_units(b.column("v").take(pa.array(own))))
                parts = [(own[r], (np.int64(t) << 48) | leaf) for t, r, leaf in plan.forest(dim).leaves(x, depth[own])]
                rows, code = (np.concatenate(z) for z in zip(*parts))
                by = np.lexsort((code, rows))
                rows, code = rows[by], code[by]
                n = np.bincount(rows, minlength=b.num_rows)
                ends = (np.cumsum(n) * 8).astype(np.int64)
                packed = code.tobytes()
                codes = pa.array([packed[e - 8 * k : e] for e, k in zip(ends.tolist(), n.tolist())], pa.binary())
                for lo in range(0, len(rows), 4096):
                    take = pa.array(rows[lo : lo + 4096])
                    yield pa.record_batch([*(b.column(c).take(take) for c in shape[:5]), pa.array(code[lo : lo + 4096]), codes.take(take), b.column("v").take(take)], names=shape)

    return run


def _lists(column: pa.Array) -> np.ndarray:
    """Leaf lists as rows of equal length, filled with -1."""
    lists = [np.frombuffer(z.as_buffer(), np.int64) for z in column]
    out = np.full((len(lists), max(map(len, lists))), -1, np.int64)
    for k, z in enumerate(lists):
        out[k, : len(z)] = z
    return out


def _compare(least: float):
    def run(keys, table):
        """One leaf, or two blocks of it; side -1: within, 0 against 1: between. (id, key, links, low) of those that link.

        Several vectors can have one id, so that a class is known by its id and key.
        """
        here = keys[2].as_py()
        ids, key, copies, side = (table.column(c).to_numpy() for c in ("id", "key", "copies", "side"))
        x = np.stack(_units(table.column("v").combine_chunks()))
        lists = None
        p, q = (np.flatnonzero(side == -1),) * 2 if (side == -1).any() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links, low = np.zeros(len(ids), np.int64), ids.copy()
        found = []
        for k in range(0, len(p), 512):
            i, j = np.nonzero(x[p[k : k + 512]] @ x[q].T >= least - 1e-12)
            i, j = p[i + k], q[j]
            if p is q:
                ok = i < j
                i, j = i[ok], j[ok]
            for m in range(0, len(i), _PAIRS):
                a, b = i[m : m + _PAIRS], j[m : m + _PAIRS]
                # in double precision, by one and the same formula for all
                ok = np.einsum("ij,ij->i", x[a], x[b]) >= least
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                found.append((a, b))
                lists = _lists(table.column("codes").combine_chunks()) if lists is None else lists
                before = np.zeros(len(a), bool)
                for c in range(lists.shape[1]):
                    z = lists[a, c]
                    use = np.flatnonzero((z >= 0) & (z < here))
                    before[use] |= (lists[b[use]] == z[use][:, None]).any(axis=1)
                a, b = a[~before], b[~before]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
        if found:
            a, b = (np.concatenate(z) for z in zip(*found))
            while True:
                old = low.copy()
                np.minimum.at(low, a, low[b])
                np.minimum.at(low, b, low[a])
                if (old == low).all():
                    break
        hit = (links > 0) | (low != ids)
        return pa.table({"id": pa.array(ids[hit]), "key": pa.array(key[hit]), "links": pa.array(links[hit]), "low": pa.array(low[hit])})

    return run


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as unit vectors of doubles, and the bytes they are equal by."""
    for b in batches:
        ids, labels, vs, raw, dims = [], [], [], [], []
        for i, label, v in zip(b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("v")):
            if not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                norm = float(np.sqrt((x * x).sum()))
            if not np.isfinite(x).all() or not x.any():
                continue
            if not np.isfinite(norm) or norm < 1e-150:
                x = x / np.abs(x).max()
                norm = float(np.sqrt((x * x).sum()))
            ids.append(i)
            labels.append(label)
            raw.append((x + 0.0).tobytes())
            vs.append((x / norm).tobytes())
            dims.append(len(x))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(vs, pa.binary())], names=["id", "label", "dim", "raw", "v"])


def near_dedup(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links, component_id, kept) per row, and links (a, b) that span the components of distinct vectors."""
    common.ship(spark)
    base = common.workdir(spark, "forest")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    good = rows.where("id is not null and label is not null").mapInArrow(_clean, "id long, label string, dim int, raw binary, v binary")
    good = common.saved(good.dropDuplicates(["id", "label", "raw"]).withColumn("h", F.sha2("raw", 256)).drop("raw"), f"{base}/good")
    reps = good.groupBy("label", "dim", "h").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = common.saved(good.join(reps, ["label", "dim", "h"]).select("id", F.xxhash64("label", "dim", "h").alias("key"), "label", "dim", "rep", "copies", F.when(F.col("id") == F.col("rep"), F.col("v")).alias("v")), f"{base}/reps")
    unique = reps.where("v is not null").select("id", "key", "label", "dim", "copies", "v")
    n, widest = unique.agg(F.count("*"), F.max("dim")).first()
    few = unique.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(min(SAMPLE, max(1, SAMPLE_BYTES // (8 * (widest or 1)))))
    plan = _Plan(few.select("label", "v").toArrow(), n, trees)
    leaves = unique.mapInArrow(_plant(plan), "id long, key long, label string, dim int, copies long, code long, codes binary, v binary")
    leaves = common.saved(leaves, f"{base}/leaves")
    leaf = ["label", "dim", "code"]
    sizes = leaves.groupBy(*leaf).agg(F.count("*").alias("m"))
    placed = leaves.join(sizes.where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")), leaf).withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    # each block with itself (once) and with each other block (as side 0 or 1)
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y"), F.when(k == F.col("block"), -1).when(F.col("block") < k, 0).otherwise(1).alias("side")))
    held = ["id", "key", *leaf, "copies", "codes", "v"]
    tasks = placed.select(*held, F.explode(pair).alias("p")).select(*held, F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.side").alias("side"))
    found = common.saved(tasks.groupBy(*leaf, "x", "y").applyInArrow(_compare(cosine), "id long, key long, links long, low long"), f"{base}/found")
    # A class has its copies' links with each other, and those of linked classes.
    near = found.groupBy(F.col("id").alias("rep"), "key").agg(F.sum("links").alias("near"))
    links = found.where("low <> id").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    edges = links.union(reps.where("id <> rep").select("id", "rep"))
    comp = common.components(spark, edges, base)
    per = reps.join(near, ["rep", "key"], "left").groupBy("id").agg(F.sum(F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(per.withColumnRenamed("id", "vec_id"), "vec_id", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), links

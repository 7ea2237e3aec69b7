"""Exact n-gram Jaccard self-join by vertical partitioning.

1. Every distinct 5-word shingle gets a place in one global order, rarest
   first: a count of all shingles in a table of fixed size, ties by hash.
2. A document's prefix in that order goes to the fragments of its shingles;
   documents that meet in one are candidates if a bound on their overlap,
   from sizes and places, can still reach the threshold.
3. The order is cut into fragments of equal mass; within each, the rarest
   first, the overlap of candidate pairs is counted separately, and the partial
   counts are summed per pair. A pair whose sum can no longer reach the
   threshold goes no further; nor does one whose parities already bound it: bit
   by bit, the parity of how many of a text's shingles have a hash, which two
   texts differ in at no more places than they have shingles apart.
4. Links are joined to components. Long posting lists first compare all
   documents with a few of them; whatever then still lies in different
   components is compared in full, so that no link between components is lost
   and no list of near copies is expanded into all its pairs. The links
   returned thus span the components; they need not be all links within one.

Nulls and rows: a null or empty text has no shingles and links with nothing.
Rows that repeat a doc_id count as one document, which has the links of each
of its texts. Rows without doc_id link with nothing and get a null component.
Columns other than doc_id and text are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ionflow.llm import common, textvec

#: Entries of the count table behind the global order: 8 MB, whatever the input.
BUCKETS_LOG2 = 21
#: Words of a shingle; similarity in percent.
WORDS, PERCENT = 5, 75
#: Posting lists up to this length are compared in full at once.
SHORT_LIST = 8
#: In longer ones each is first compared with so many that have the fewest rare shingles, and the next one.
LEADERS = 3
#: Rows of a posting list that one task may get; longer ones are salted.
SALT_ROWS = 512
#: Fragments of the global order in which overlaps are counted.
FRAGMENTS = 4
_PARTS = [f"t{k}" for k in range(FRAGMENTS)]
#: 64-bit words of a text's parities.
_WORDS = 8
_PARITIES = [f"p{k}" for k in range(_WORDS)]
#: A text is known by its document and its digest, since rows that repeat a doc_id can hold several.
_PREFIX = ["tok", "salt", "doc", "d", "n", "pos"]
_PREFIX_TYPES = "tok long, salt int, doc long, d long, n int, pos int"
_PAIR = ["a", "da", "b", "db", "na", "nb"]
#: Pieces of the count table that are summed apart, and tasks for each in the first step.
_CHUNKS, _LANES = 16, 8


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, shingle hashes, their rows), repeats included."""
    for i, j, words, counts, _, _ in textvec.WordHasher(textvec.SPACED).batches(column):
        v, r = textvec.shingles(words, counts, WORDS)
        yield i, j, v, r


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's size and digest; per task the counts by bucket."""
    table = np.zeros(1 << BUCKETS_LOG2, np.uint32)
    shift = np.uint64(64 - BUCKETS_LOG2)
    for b in batches:
        for i, j, v, r in _sets(b.column(1)):
            v, r, n = textvec.distinct_by_row(v, r, j - i)
            table += np.bincount(v >> shift, minlength=len(table)).astype(np.uint32)
            d1, d2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
            if len(v):
                at = np.cumsum(n) - n
                full = n > 0
                d1[full] = np.add.reduceat(textvec.mix(v), at[full])
                d2[full] = np.add.reduceat(textvec.mix(v ^ np.uint64(0x2545F4914F6CDD1D)), at[full])
            yield pa.record_batch(
                [b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())],
                names=["doc_id", "n", "d1", "d2", "chunk", "counts"],
            )
    if table.any():
        part = np.split(table, _CHUNKS)
        z = pa.nulls(_CHUNKS, pa.int64())
        yield pa.record_batch([z, z, z, z, pa.array(np.arange(_CHUNKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in part], pa.binary())], names=["doc_id", "n", "d1", "d2", "chunk", "counts"])


def _sum_counts(partial: bool):
    """Sums of counts by chunk: packed 64-bit numbers again where partial."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(z), np.uint32 if partial else np.uint64).astype(np.uint64)
                total[c] = total[c] + x if c in total else x
        if total:
            packed = [zlib.compress(v.tobytes(), 1) if partial else v.tobytes() for v in total.values()]
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])

    return run


def _levels(table: np.ndarray) -> np.ndarray:
    """The global order by bucket: a level of its count; within a level the order is by hash."""
    return np.minimum(8 * np.log2(1 + table.astype(np.float64)), 255).astype(np.uint8)


def _place(v: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Places of shingles in the global order."""
    bucket = (v >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    return (level[bucket].astype(np.uint64) << np.uint64(56)) | (v >> np.uint64(8))


def _cuts(table: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Places where fragments begin after the first, so that each holds an equal share of all shingles."""
    mass = np.bincount(level, table.astype(np.float64), minlength=256)
    ends = np.cumsum(mass)
    want = ends[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS
    at = np.searchsorted(ends, want)
    share = (want - (ends[at] - mass[at])) / np.maximum(mass[at], 1)
    return (at.astype(np.uint64) << np.uint64(56)) | (np.clip(share, 0, 1) * (2**56 - 1)).astype(np.uint64)


def _prefixes(table: np.ndarray, level: np.ndarray):
    """Prefix rows of each document; table: the counts by bucket."""
    table = np.minimum(table, 2**40).astype(np.float32)
    #: a bucket far above the usual holds a frequent shingle; what is dealt by it is salted
    usual = np.median(table)
    over = np.maximum(table - 2 * usual, 0) / SALT_ROWS
    salts = (1 << np.minimum(np.ceil(np.log2(1 + over)), 12).astype(np.int64)).astype(np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, seen = np.uint64(64 - BUCKETS_LOG2), set()
        for b in batches:
            ids = b.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for i, j, v, r in _sets(b.column(1)):
                if not len(v):
                    continue
                v, r, n = textvec.distinct_by_row(v, r, j - i, _place(v, level))
                start = np.cumsum(n) - n
                # copies within a task go once
                dig = np.zeros(j - i, np.uint64)
                dig[n > 0] = np.add.reduceat(textvec.mix(v), start[n > 0])
                use = known[i:j] & (n > 0)
                for k in np.flatnonzero(use):
                    key = (int(dig[k]), int(n[k]))
                    if key in seen:
                        use[k] = False
                    seen.add(key)
                pos = np.arange(len(v)) - start[r]
                p = n - (PERCENT * n + 99) // 100 + 1
                keep = (pos < p[r]) & use[r]
                v, r, pos = v[keep], r[keep], pos[keep]
                doc = ids[i:j][r]
                s = salts[(v >> shift).astype(np.int64)].astype(np.int64)
                salt = (textvec.mix(doc.astype(np.int64).view(np.uint64)) % s.astype(np.uint64)).astype(np.int32)
                salt[s == 1] = -1
                yield pa.record_batch([pa.array(v.view(np.int64)), pa.array(salt), pa.array(doc.astype(np.int64)), pa.array(dig[r].view(np.int64)), pa.array(n[r].astype(np.int32)), pa.array(pos.astype(np.int32))], names=_PREFIX)

    return run


def _may_link(na, nb, pa_, pb):
    """Whether the overlap can still reach the threshold, the pair's first common shingle standing here."""
    need = -(-PERCENT * (na + nb) // (100 + PERCENT))
    return np.minimum(na - pa_, nb - pb) >= need


def _pairs(second: bool):
    """Candidate pairs of lists sorted by (tok, salt, pos, hash of doc); rows of long and salted lists also go on."""

    def emit(tok, salt, doc, d, n, pos):
        m = len(tok)
        new = np.ones(m, bool)
        new[1:] = (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, m))
        first, mine = np.repeat(at, size), np.repeat(size, size)
        end = first + mine
        left, right = [], []
        idx = np.arange(m)
        for k in range(1, SHORT_LIST):
            i = idx[(idx + k < end) & ((k == 1) | (mine <= SHORT_LIST))]
            left.append(i)
            right.append(i + k)
        for k in range(LEADERS):
            i = idx[(mine > SHORT_LIST) & (idx > first + k)]
            left.append(first[i] + k)
            right.append(i)
        x, y = np.concatenate(left), np.concatenate(right)
        ok = (doc[x] != doc[y]) & _may_link(n[x], n[y], pos[x], pos[y])
        x, y = x[ok], y[ok]
        swap = doc[x] > doc[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        by = np.lexsort((d[y], d[x], doc[y], doc[x]))
        x, y = x[by], y[by]
        if len(x):
            one = np.zeros(len(x), bool)
            one[0] = True
            for c in (doc[x], doc[y], d[x], d[y]):
                one[1:] |= c[1:] != c[:-1]
            x, y = x[one], y[one]
        long = np.zeros(m, bool) if second else (mine > SHORT_LIST) | (salt >= 0)
        lead = np.zeros(m, bool) if second else new & (salt >= 0)
        out = []
        none = np.zeros(m, np.int64)
        for kind, a, da, b, db, na, nb, t in (
            (0, doc[x], d[x], doc[y], d[y], n[x], n[y], np.zeros(len(x), np.int64)),
            (1, doc[long], d[long], none[long], none[long], n[long], pos[long], tok[long]),
            (2, doc[lead], d[lead], none[lead], none[lead], n[lead], pos[lead], tok[lead]),
        ):
            if len(a):
                out.append(pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), *map(pa.array, (a, da, b, db)), pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32)), pa.array(t)], names=["kind", *_PAIR, "tok"]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(cols[0]):
                continue
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols)]
            differs = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            if cut:
                yield from emit(*(c[:cut] for c in cols))
            carry = [c[cut:] for c in cols]
        if carry is not None:
            yield from emit(*carry)

    return run


def _fragments(level: np.ndarray, cuts: np.ndarray):
    """Each document's parities, and its shingles by fragment of the global order: a column a fragment, sorted and packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, now = set(), None  # rows come by document: those that repeat one's text go once
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, v, r in _sets(b.column(1)):
                m = j - i
                v, r, n = textvec.distinct_by_row(v, r, m)
                dig = np.zeros(m, np.uint64)
                if len(v):
                    dig[n > 0] = np.add.reduceat(textvec.mix(v), (np.cumsum(n) - n)[n > 0])
                part = np.searchsorted(cuts, _place(v, level), "right")
                columns = []
                for k in range(FRAGMENTS):
                    own = part == k
                    size = np.bincount(r[own], minlength=m)
                    ends = np.concatenate([[0], np.cumsum(size) * 8]).astype(np.int32)
                    columns.append(pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(ends), pa.py_buffer(v[own].tobytes())]))
                bit = (textvec.mix(v) % np.uint64(64 * _WORDS)).astype(np.int64)
                odd = (np.bincount(r * (64 * _WORDS) + bit, minlength=m * 64 * _WORDS) & 1).astype(np.uint8)
                words = np.packbits(odd.reshape(m, _WORDS, 64), axis=2).view(np.int64)[:, :, 0]
                use = n > 0
                for k, (doc, x) in enumerate(zip(ids[i:j].tolist(), dig.tolist())):
                    if doc != now:
                        now = doc
                        seen.clear()
                    use[k] &= x not in seen
                    seen.add(x)
                yield pa.record_batch([b.column(0).slice(i, m), pa.array(dig.view(np.int64)), *(pa.array(words[:, k].copy()) for k in range(_WORDS)), *columns], names=["doc", "d", *_PARITIES, *_PARTS]).filter(pa.array(use))

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlap of each pair in one fragment, and how many shingles each has in it."""
    for b in batches:
        here, xs, ys = np.zeros((3, b.num_rows), np.int32)
        for k, (x, y) in enumerate(zip(b.column("ta"), b.column("tb"))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            xs[k], ys[k] = len(x), len(y)
            if len(x) and len(y):
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                here[k] = int((both[1:] == both[:-1]).sum())
        kept = [*_PAIR, "both", "ra", "rb"]
        yield pa.record_batch([*(b.column(c) for c in kept), pa.array(here), pa.array(xs), pa.array(ys)], names=[*kept, "here", "xa", "xb"])


def _verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, cut: tuple, base: str, tag: str) -> DataFrame:
    """The pairs that link: those that parities leave are counted fragment by fragment, rarest shingles first, and summed per pair.

    A fragment is a stage of its own that reads only its column of the sets. A
    pair goes on while its sum and what both still have can reach the threshold.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # sort-merge joins at every size: plans, and so disk, grow in proportion
    shape = "doc long, d long, " + ", ".join([*(f"{c} long" for c in _PARITIES), *(f"{c} binary" for c in _PARTS)])
    sets = common.saved(docs.hint("merge").join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_fragments(*cut), shape), f"{base}/sets{tag}")
    common.release(spark)
    left = pairs.select(*_PAIR, F.lit(0).alias("both"), F.col("na").alias("ra"), F.col("nb").alias("rb"))
    apart = sum((F.bit_count(F.col("pa")[k].bitwiseXOR(F.col("pb")[k])) for k in range(_WORDS)), F.lit(0))
    most = F.floor((F.col("na") + F.col("nb") - apart) / 2)
    for k, part in enumerate(_PARTS):
        for c in ("b", "a"):
            # the rarest shingles come with the parities
            own = [F.col(part).alias(f"t{c}"), *([] if k else [F.array(*_PARITIES).alias(f"p{c}")])]
            left = left.join(sets.select(F.col("doc").alias(c), F.col("d").alias(f"d{c}"), *own).hint("merge"), [c, f"d{c}"])
        left = left if k else left.where(100 * most >= PERCENT * (F.col("na") + F.col("nb") - most))
        left = left.select(*_PAIR, "both", "ra", "rb", "ta", "tb").mapInArrow(_overlaps, "a long, da long, b long, db long, na int, nb int, both int, ra int, rb int, here int, xa int, xb int")
        left = left.select(*_PAIR, F.expr("both + here").alias("both"), F.expr("ra - xa").alias("ra"), F.expr("rb - xb").alias("rb"))
        left = left.where(f"100 * (both + least(ra, rb)) >= {PERCENT} * (na + nb - both - least(ra, rb))")
        with common.arrow_rows(spark, 250):
            left = common.saved(left, f"{base}/partial{tag}{k}")
        if k:
            common.remove(spark, f"{base}/partial{tag}{k - 1}")
    out = common.saved(left.where(f"100 * both >= {PERCENT} * (na + nb - both)").select("a", "b").distinct(), f"{base}/links{tag}")
    common.remove(spark, f"{base}/sets{tag}", f"{base}/partial{tag}{len(_PARTS) - 1}")
    common.release(spark)
    return out


def _of_classes(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """pairs between the first documents of each class of equal sets; the digest tells which of a document's texts it is."""
    for x in ("a", "b"):
        pairs = pairs.join(copies.select(F.col("doc_id").alias(x), F.col("d1").alias(f"d{x}"), "rep"), [x, f"d{x}"], "left").withColumn(x, F.coalesce("rep", x)).drop("rep")
    return _ordered(pairs.where("a <> b"), "a", "b").distinct()


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """pairs with the smaller document first."""
    swap = F.col(x) > F.col(y)
    cols = ((x, f"d{x}", f"n{x}"), (y, f"d{y}", f"n{y}"))
    first = [F.when(swap, F.col(b)).otherwise(F.col(a)) for a, b in zip(*cols)]
    second = [F.when(swap, F.col(a)).otherwise(F.col(b)) for a, b in zip(*cols)]
    return pairs.select(*(c.alias(n) for c, n in zip((first[0], first[1], second[0], second[1], first[2], second[2]), _PAIR)))


def jaccard_components(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id) per row of docs, and the verified links (a, b)."""
    common.ship(spark)
    base = common.workdir(spark, "ngram")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with common.arrow_rows(spark, 1000):
        return _joined(spark, docs, base)


def _joined(spark: SparkSession, docs: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    scan = common.saved(docs.mapInArrow(_scan, "doc_id long, n long, d1 long, d2 long, chunk int, counts binary"), f"{base}/scan")
    rows = scan.where("chunk is null").select("doc_id", "n", "d1", "d2")
    counts = scan.where("chunk is not null").select("chunk", "counts", (F.spark_partition_id() % _LANES).alias("lane"))
    # summed in two steps, so that no task reads what all tasks have counted
    some = counts.repartition(_CHUNKS * _LANES, "chunk", "lane").select("chunk", "counts").mapInArrow(_sum_counts(True), "chunk int, counts binary")
    counts = some.repartition(_CHUNKS, "chunk").mapInArrow(_sum_counts(False), "chunk int, counts binary")
    table = np.zeros(1 << BUCKETS_LOG2, np.uint64)
    for c, z in counts.collect():  # as many entries as the table has, whatever the input
        table[c * (len(table) // _CHUNKS) : (c + 1) * (len(table) // _CHUNKS)] = np.frombuffer(z, np.uint64)

    level = _levels(table)
    cut = (level, _cuts(table, level))
    prefix = docs.mapInArrow(_prefixes(table, level), _PREFIX_TYPES)
    shape = "kind int, a long, da long, b long, db long, na int, nb int, tok long"
    found = common.saved(prefix.repartition("tok", "salt").sortWithinPartitions("tok", "salt", "pos", F.xxhash64("doc"), "doc", "d").mapInArrow(_pairs(False), shape), f"{base}/found")
    common.release(spark)
    leads = found.where("kind = 2").select("tok", F.lit(-1).alias("salt"), F.col("a").alias("doc"), F.col("da").alias("d"), F.col("na").alias("n"), F.col("nb").alias("pos"))
    more = leads.repartition("tok").sortWithinPartitions("tok", "pos", F.xxhash64("doc"), "doc", "d").mapInArrow(_pairs(True), shape)
    # a table of its own, so that the copies of one text, however many, can be dealt to several tasks of the join
    low = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("top > rep").drop("top")
    low = common.saved(low, f"{base}/classes")
    copies = rows.where("n > 0").hint("merge").join(low, ["d1", "d2", "n"]).where("doc_id <> rep").select("doc_id", "d1", "rep")
    copies = common.saved(copies.distinct(), f"{base}/copies")
    pairs = common.saved(_of_classes(found.union(more).where("kind = 0").select(*_PAIR).distinct(), copies), f"{base}/pairs")
    links = _verified(spark, docs, pairs, cut, base, "1")
    copies_ = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = common.saved(common.components(spark, links.union(copies_), f"{base}/c1"), f"{base}/comp1")

    # Long lists: what still lies in different components is compared in full.
    long = found.where("kind = 1").select("tok", F.col("a").alias("doc"), F.col("da").alias("d"), F.col("na").alias("n"), F.col("nb").alias("pos"))
    long = long.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    by = long.groupBy("tok", "component").agg(F.count("*").alias("m"))
    mixed = by.groupBy("tok").agg(F.max_by("component", "m").alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    long = common.saved(long.join(mixed, "tok"), f"{base}/long")
    x = long.where("component <> main").select("tok", F.col("doc").alias("x"), F.col("d").alias("dx"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("component").alias("cx"))
    y = long.select("tok", F.col("doc").alias("y"), F.col("d").alias("dy"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("component").alias("cy"), "main")
    # holds at the first shingle that a pair that links has in common
    first = f"{100 + PERCENT} * least(nx - px, ny - py) >= {PERCENT} * (nx + ny)"
    rest = x.join(y, "tok").where(f"cx <> cy and (cy = main or x < y) and 100 * least(nx, ny) >= {PERCENT} * greatest(nx, ny) and {first}")
    rest = _ordered(rest.select("x", "dx", "y", "dy", "nx", "ny").distinct(), "x", "y")
    rest = common.saved(_of_classes(rest, copies).join(pairs.select("a", "da", "b", "db"), ["a", "da", "b", "db"], "left_anti"), f"{base}/rest")
    if not rest.isEmpty():
        late = _verified(spark, docs, rest, cut, base, "2")
        if not late.isEmpty():
            links = links.union(late)
            comp = common.saved(common.components(spark, links.union(copies_), f"{base}/c2"), f"{base}/comp2")
    out = rows.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), links.distinct()


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component the smallest doc_id stays, once."""
    comp, _ = jaccard_components(spark, docs)
    first = comp.where("doc_id = component_id").select("doc_id").distinct()
    one = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    place = common.free_name(docs, "row")
    own = docs.join(first, "doc_id", "left_semi").withColumn(place, one).where(F.col(place) == 1).drop(place)
    return own.select(*(F.col(f"`{c}`") for c in docs.columns)).union(docs.where("doc_id is null"))

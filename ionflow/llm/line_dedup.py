"""Line dedup: range-partitioned hashes, first occurrences streamed, keep bitmaps returned.

Lines are hashed to 128 bits and range-partitioned by (hash, document,
position), so that a line which half of all documents hold spreads over many
partitions. Each partition streams its rows in order: of a hash's run the first
document keeps its lines, the others drop them. The first run of a partition
may have begun in an earlier one; the smallest document of such runs comes
from a table of two rows a partition. What leaves are compressed bitmaps of
the lines each document keeps, not text.

A text is split at \\n; null or empty is one empty line. A line's key is the
line with spaces and \\t to \\r stripped at both ends and A-Z in lower case;
keys under min_chars code points always stay. Rows that repeat a doc_id count
as one document; null doc_ids come last and count as one document each text.
Columns other than doc_id and text pass through apply_bitmaps unchanged; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ionflow.llm import common

MIN_CHARS = 10
_MADE = [T.StructField("text", T.StringType()), T.StructField("lines", T.LongType()), T.StructField("dropped", T.LongType())]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\x0c\r"
_NO_ID = 2**63 - 1


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _ident() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to drop, in order of (h1, h2, doc, pos).

    kind 0: drop. kind 1: of the partition's first run, drop if doc is larger
    than the run's smallest anywhere. kind 2: smallest doc of the first and of
    the last run here.
    """
    names = ["kind", "h1", "h2", "doc", "tag", "pos"]
    last: tuple[int, int] | None = None  # hash of the run under way
    low = 0  # and its first document
    head = True  # whether it is the partition's first run
    ends: list[tuple[int, int, int]] = []
    for b in batches:
        h1, h2, doc, tag, pos = (c.to_numpy() for c in b.columns)
        m = len(h1)
        if not m:
            continue
        new = np.ones(m, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        joins = last == (int(h1[0]), int(h2[0]))
        if last is None:
            ends.append((int(h1[0]), int(h2[0]), int(doc[0])))
        new[0] = not joins
        run = np.cumsum(new)  # 0: the run from the batch before
        starts = np.flatnonzero(new)
        first = np.concatenate([[low], doc[starts]])[run]
        in_head = (run == 0) if joins else np.zeros(m, bool)
        in_head &= head
        if last is None:
            in_head = run == 1
        if (last is not None and len(starts)) or (last is None and len(starts) > 1):
            head = False
        drop = (doc > first) & ~in_head
        for kind, rows in ((0, drop), (1, in_head)):
            if rows.any():
                yield pa.record_batch([pa.array(np.full(int(rows.sum()), kind, np.int32)), *(pa.array(c[rows]) for c in (h1, h2, doc, tag, pos))], names=names)
        if len(starts):
            low = int(doc[starts[-1]])
        last = (int(h1[-1]), int(h2[-1]))
    if last is not None:
        ends.append((*last, low))
        a = np.array(ends, np.int64)
        z = np.zeros(len(a), np.int64)
        yield pa.record_batch([pa.array(np.full(len(a), 2, np.int32)), pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(a[:, 2]), pa.array(z), pa.array(z.astype(np.int32))], names=names)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for pos in b.column("dropped"):
            at = np.array(pos.as_py(), np.int64)
            bits = np.ones((int(at.max()) // 8 + 1) * 8, np.uint8)
            bits[at] = 0
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
        yield pa.record_batch([b.column("doc"), b.column("tag"), pa.array(out, pa.binary())], names=["doc", "tag", "keep"])


def keep_bitmaps(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, tag, keep): a compressed bitmap for each document that drops lines.

    doc is the doc_id (the largest bigint where null) and tag a hash of the
    text, which tells apart rows that repeat a doc_id. Bit k of the inflated
    bitmap tells whether line k stays; lines beyond its end stay.
    """
    common.ship(spark)
    base = common.workdir(spark, "lines")
    lines = docs.select(_ident().alias("doc"), F.xxhash64(_text()).alias("tag"), F.posexplode(F.split(_text(), "\n", -1)).alias("pos", "line"))
    key = F.translate(F.trim(F.col("line"), F.lit(_BLANK)), _UPPER, _LOWER)
    lines = lines.select("doc", "tag", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    hashed = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "tag", "pos")
    hashed = common.saved(hashed, f"{base}/hashed")  # the range sampling must not split all texts again
    order = ["h1", "h2", "doc", "pos"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("h1", "h2", "doc", "tag", "pos")
    runs = common.saved(runs.mapInArrow(_first_runs, "kind int, h1 long, h2 long, doc long, tag long, pos int"), f"{base}/runs")
    common.remove(spark, f"{base}/hashed")
    # Two rows a partition at most, whatever the input.
    low = runs.where("kind = 2").groupBy("h1", "h2").agg(F.min("doc").alias("low"))
    late = runs.where("kind = 1").join(F.broadcast(low), ["h1", "h2"]).where("doc > low")
    dropped = runs.where("kind = 0").select("doc", "tag", "pos").union(late.select("doc", "tag", "pos"))
    dropped = dropped.groupBy("doc", "tag").agg(F.collect_set("pos").alias("dropped"))
    return dropped.mapInArrow(_bitmaps, "doc long, tag long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, counts, gone = [], [], []
        for t, z in zip(b.column("text"), b.column("keep")):
            lines = (t.as_py() or "").split("\n")
            n = len(lines)
            if z.is_valid:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(z.as_buffer()), np.uint8), bitorder="little")[:n]
                lines = [x for x, k in zip(lines, bits) if k] + lines[len(bits) :]
            texts.append("\n".join(lines))
            counts.append(n)
            gone.append(n - len(lines))
        yield pa.record_batch([b.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=["row", "text", "lines", "dropped"])


def apply_bitmaps(spark: SparkSession, docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the kept lines as text, and n_lines and n_dropped (with _ before them where docs has such columns)."""
    # other columns travel in one struct, where their names clash with nothing
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(0))
    rows = docs.select(row.alias("row"), _text().alias("text"), _ident().alias("doc"), F.xxhash64(_text()).alias("tag"))
    rows = rows.join(bitmaps, ["doc", "tag"], "left").select("row", "text", "keep")
    names = common.free_name(docs, "n_lines"), common.free_name(docs, "n_dropped")
    out = rows.mapInArrow(_apply, T.StructType([rows.schema["row"], *_MADE]))
    own = [F.col("row").getField(c).alias(c) if c != "text" else F.col("text") for c in docs.columns]
    return out.select(*own, F.col("lines").alias(names[0]), F.col("dropped").alias(names[1]))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the lines that an earlier document holds, and n_lines and n_dropped."""
    return apply_bitmaps(spark, docs, keep_bitmaps(spark, docs, min_chars))

"""Exact dedup as a stateful stream: disk-backed keyed state without expiry.

Documents stream in as files arrive. The state, kept in RocksDB and never
expired, holds for each digest of a normalised text how many rows had it and
the row to keep: its length, stable identifier (doc_id) and content locator
(file and row in it). A row whose digest the state already has is a hit; hits
are compared with the kept row's text byte by byte, and where texts of one
digest differ, its rows are grouped by the text itself. Rows of a digest that
very many share are dealt to several tasks, each with a copy of its state.

Equal texts are those identical once space and \\t to \\r are deleted; null
counts as empty. Of equal texts the row with most code points in the original
text stays, then the smallest doc_id (null last); rows that tie in both count
as the same row and are all marked as kept. Other columns are ignored, and an
empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ionflow.llm import common

#: Characters that do not count.
BLANK = " \t\n\x0b\x0c\r"
#: Bits of the filter of repeated digests: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
_WORD = 32768  # bits of one bitmap of bitmap_construct_agg
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no file space is reserved, and a commit uploads changes only
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_NO_ID = 2**63 - 1
#: A digest is hot with more rows than this, and more than one in HOT_SHARE of all: at most HOT_SHARE digests.
HOT_ROWS, HOT_SHARE = 1000, 10_000
#: Tasks that the rows of a hot digest are dealt to.
SALTS = 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANK, "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _only(path: str) -> str:
    """A glob that nothing but path matches: a stream takes a file, unlike a folder, by a glob alone."""
    path = re.sub(r"([\\{}\[\]*?])", r"\\\1", path.rstrip("/"))
    return re.sub(r"([0-9A-Za-z])(?=[^0-9A-Za-z]*$)", r"[\1]", path, count=1)


def update_state(spark: SparkSession, path: str, checkpoint: str, digest=sha256) -> DataFrame:
    """Stream what is new under path into the state; the state as (digest, size, best).

    Call it again with the same checkpoint when more files have come.
    """
    schema = spark.read.parquet(path).schema
    old = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        rows = spark.readStream.schema(schema).parquet(_only(path))
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        best = F.struct(
            F.length(text).alias("chars"),
            (-F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).alias("neg_id"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        )
        state = rows.select(digest(normalised(F.col("text"))).alias("digest"), best.alias("best")).groupBy("digest").agg(F.count("*").alias("size"), F.max("best").alias("best"))
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = spark.read.format("statestore").load(checkpoint)
    count, most = kept.schema["value"].dataType.names[:2]
    return kept.select(F.col("key.digest").alias("digest"), F.col("value")[count].alias("size"), F.col("value")[most].alias("best"))


def _maybe_repeated(spark: SparkSession, state: DataFrame, base: str):
    """A bound on the digests with several rows: a bitmap of FILTER_BITS bits, to broadcast."""
    h = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS))
    bits = state.where("size > 1").select((h.cast("long")).alias("h"))
    bits = bits.groupBy(F.floor(F.col("h") / _WORD).cast("int").alias("word")).agg(F.bitmap_construct_agg((F.col("h") % _WORD)).alias("bits"))
    return common.saved(bits, f"{base}/repeated")


def _hot(state: DataFrame, base: str) -> DataFrame:
    """The hot digests, at most HOT_SHARE of them, to broadcast."""
    rows = state.agg(F.sum("size")).first()[0] or 0
    least = max(HOT_ROWS, rows // HOT_SHARE)
    return common.saved(state.where(F.col("size") > least).select("digest", F.lit(True).alias("hot")), f"{base}/hot")


def _salted(one_each: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of one digest each, repeated for every salt where the digest is hot."""
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return one_each.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.explode(salts)).drop("hot")


def exact_groups(spark: SparkSession, path: str, digest=sha256, checkpoint: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of the table at path."""
    base = common.workdir(spark, "exact")
    state = common.saved(update_state(spark, path, checkpoint or f"{base}/stream", digest), f"{base}/state")
    docs = spark.read.parquet(path).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Generators, so that no optimizer rule repeats the costly expressions in a filter or join key.
    docs = docs.select("doc_id", F.length("text").alias("chars"), F.explode(F.array(normalised(F.col("text")))).alias("norm"))
    docs = docs.select("doc_id", "chars", "norm", F.explode(F.array(digest(F.col("norm")))).alias("digest"))
    h = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS))
    docs = docs.withColumn("h", h).withColumn("word", F.floor(F.col("h") / _WORD).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast((h % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    repeated = F.coalesce(byte.bitwiseAND(F.expr("cast(power(2, h % 8) as int)")) != 0, F.lit(False))
    # One pass: all rows by digest, and the bytes of those whose digest may be repeated.
    rows = docs.join(F.broadcast(_maybe_repeated(spark, state, base)), "word", "left")
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("ident"), "chars", "digest", F.sha2("norm", 256).alias("text_sha256"), F.when(repeated, F.col("norm")).alias("norm"))
    hot = _hot(state, base)
    salt = F.when(F.col("hot"), F.monotonically_increasing_id() % SALTS).otherwise(0).cast("int")
    rows = rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", salt).drop("hot")
    rows = common.saved(rows, f"{base}/rows")

    # Full bytes of hits against the kept row's.
    some = rows.where("norm is not null").select("digest", "salt", "ident", "chars", "norm")
    many = state.where("size > 1")
    first = some.join(many.select("digest", F.col("best.chars").alias("chars"), (-F.col("best.neg_id")).alias("ident")), ["digest", "chars", "ident"])
    # Rows that tie with the kept one may hold other texts only under a weak digest: one of them is the locator's.
    first = first.groupBy("digest").agg(F.min("norm").alias("kept_norm"))
    hits = some.join(_salted(first, hot), ["digest", "salt"]).where(F.col("norm") != F.col("kept_norm"))
    odd = common.saved(hits.select("digest").distinct(), f"{base}/odd")

    light = rows.select("doc_id", "ident", "chars", "digest", "salt", "text_sha256")
    out = light.join(_salted(state, hot), ["digest", "salt"]).select("doc_id", "ident", "chars", "digest", "text_sha256", "size", F.col("best.chars").alias("keep_chars"), (-F.col("best.neg_id")).alias("keep"))
    if not odd.isEmpty():
        # One digest, several texts: the text itself is the key.
        differ = rows.join(odd, "digest", "left_semi")
        by = differ.groupBy("digest", "norm").agg(F.count("*").alias("size"), F.max(F.struct("chars", (-F.col("ident")).alias("neg_id"))).alias("best"))
        differ = differ.join(by, ["digest", "norm"]).select("doc_id", "ident", "chars", "digest", "text_sha256", "size", F.col("best.chars").alias("keep_chars"), (-F.col("best.neg_id")).alias("keep"))
        out = out.join(odd, "digest", "left_anti").unionByName(differ)
    return out.select(
        "doc_id",
        F.when(F.col("keep") != _NO_ID, F.col("keep")).alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        ((F.col("ident") == F.col("keep")) & (F.col("chars") == F.col("keep_chars"))).alias("kept"),
        "text_sha256",
    )

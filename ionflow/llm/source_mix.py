"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

1. Sizes: words of each text; per source they are summed.
2. Targets: sources in code point order (null last) have weights 1, 2, 3,
   repeating; they share the total by weight, no target above max_repeat times
   its source, what is cut off being shared again by weight.
3. The total is cut into blocks of equal words, small beside each target. Sources get blocks by highest
   quotients target / (2 k + 1): all quotients safely above the last seat count
   at once, only the few near it are ranked.
4. A source's blocks go to its shards in the same way, giving an integer quota
   for each (source, shard). A shard is a seeded hash bucket of its documents; a
   source has as many as hold SHARD_WORDS words each, one at least.
5. In a shard documents lie end to end in seeded order; the quota takes whole
   rounds of the shard and then as many consecutive blocks, from a seeded
   starting point. A document's part is what those blocks cover of it.

Null texts have size 0 and take nothing. Rows that repeat a doc_id are rows of
their own; ties in the seeded order are broken by doc_id and size, and equal
rows are interchangeable. All weights and seeds are fixed, so reruns agree. An
empty table gives no rows; if all sizes are 0, all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ionflow.llm import common

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: Words of a block; a source's part differs from its target by half of it or little more.
BLOCK_WORDS = 32
#: Blocks of the smallest target at the least: where it is small, blocks are smaller.
BLOCKS_LEAST = 50
#: Most shards of a source: the unit of the seeded order.
SHARDS = 256
#: Words of a shard at the least, so that its run of blocks is long beside a document.
SHARD_WORDS = 1 << 17
SEED = 42


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _sources(per: DataFrame) -> DataFrame:
    """(source, source_size, place, weight) from (source, size) with a row for each source."""
    by = W.orderBy(F.col("source").asc_nulls_last())
    place = per.select("source", F.col("size").alias("source_size"), (F.row_number().over(by) - 1).alias("place"))
    return place.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")))


def targets(per: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds the target: weight times one level for all sources, or the cap of those that would be above."""
    src = _sources(per).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    # in order of the level at which a source reaches its cap, those before are full
    by = W.orderBy(F.col("cap") / F.col("weight"), "place")
    src = src.withColumn("total", F.sum("source_size").over(W.partitionBy()).cast("double"))
    src = src.withColumn("full", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    src = src.withColumn("left", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    src = src.withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(W.partitionBy())
    return src.select("source", "source_size", "place", F.coalesce(F.least("cap", level * F.col("weight")), "cap").alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], seats: str, votes: str, order: str) -> DataFrame:
    """Adds quota: integer seats of each party of a group, by highest quotients votes / (2 k + 1).

    seats: the column with the seats of the group. Ties go to the smaller order.
    With d = votes / seats, rounding votes / d' gives at most the seats for
    d' = votes / (seats - n/2) and at least them for votes / (seats + n/2), n
    being the parties; only quotients between these two, about 2 n, are ranked.
    """
    by = W.partitionBy(*group)
    all_votes, n = F.sum(votes).over(by), F.count("*").over(by)
    x = parties.withColumn("__v", all_votes.cast("double")).withColumn("__n", n.cast("double"))
    low = F.when((F.col(seats) > F.col("__n") / 2) & (F.col("__v") > 0), F.floor(F.col(votes) * (F.col(seats) - F.col("__n") / 2) / F.col("__v") + 0.5 - 1e-9)).otherwise(F.lit(0))
    high = F.when(F.col("__v") > 0, F.floor(F.col(votes) * (F.col(seats) + F.col("__n") / 2) / F.col("__v") + 0.5 + 1e-9) + 1).otherwise(F.lit(0))
    x = x.withColumn("__low", F.greatest(low.cast("long"), F.lit(0))).withColumn("__high", F.when(F.col(votes) > 0, high.cast("long")).otherwise(F.col("__low")))
    more = x.withColumn("__rest", F.col(seats) - F.sum("__low").over(by)).where("__high > __low")
    more = more.select(*group, order, "__rest", F.col(votes).alias("__votes"), F.explode(F.sequence("__low", F.col("__high") - 1)).alias("__k"))
    rank = F.row_number().over(by.orderBy((F.col("__votes") / (2 * F.col("__k") + 1)).desc(), F.col(order), "__k"))
    more = more.withColumn("__rank", rank).where("__rank <= __rest").groupBy(*group, order).agg(F.count("*").alias("__more"))
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"m.{c}")) for c in [*group, order]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    x = x.alias("x").join(more.alias("m"), cond, "left").select("x.*", F.coalesce("m.__more", F.lit(0)).alias("__more"))
    return x.withColumn("quota", F.col("__low") + F.col("__more")).drop("__v", "__n", "__low", "__high", "__more")


def _seeded(salt: str, *cols: Column) -> Column:
    return F.xxhash64(F.lit(f"{SEED}:{salt}"), *cols)


def mix(spark: SparkSession, docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, text, source)."""
    base = common.workdir(spark, "mix")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    sized = common.saved(sized.withColumn("shard", F.pmod(_seeded("shard", "doc_id"), F.lit(shards)).cast("int")), f"{base}/sized")
    cells = common.saved(sized.groupBy("source", "shard").agg(F.sum("size").alias("words")), f"{base}/cells")
    # neighbouring buckets of a source join into one shard
    n_shards = F.least(F.greatest(F.floor(F.col("source_size") / SHARD_WORDS), F.lit(1)), F.lit(shards))
    joined = F.floor(F.col("shard") * n_shards / shards).cast("int")
    src = common.saved(targets(cells.groupBy("source").agg(F.sum("words").alias("size"))), f"{base}/targets")
    least = src.where("target > 0").agg(F.min("target")).first()[0]
    block_words = int(max(1, min(block_words, (least or 0) // BLOCKS_LEAST)))
    src = src.withColumn("one", F.lit(1)).withColumn("blocks", F.round(F.sum("target").over(W.partitionBy()) / block_words).cast("long"))
    src = common.saved(sainte_lague(src, ["one"], "blocks", "target", "place").select("source", "source_size", "place", "target", F.col("quota").alias("source_quota")), f"{base}/sources")
    quota = cells.alias("c").join(src.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).groupBy("s.place", "source_quota", joined.alias("shard")).agg(F.sum("words").alias("words"))
    quota = common.saved(sainte_lague(quota, ["place"], "source_quota", "words", "shard").select("place", "shard", "words", (F.col("quota") * block_words).alias("want")), f"{base}/quota")
    rows = sized.alias("d").join(src.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("doc_id", "size", joined.alias("shard"), "place", "source_size", "target")
    rows = rows.join(quota, ["place", "shard"])
    order = W.partitionBy("place", "shard").orderBy(_seeded("order", "doc_id"), "doc_id", "size")
    rows = rows.withColumn("begin", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    # whole rounds of the shard, then a run of blocks from a seeded block on, around its end
    rounds = F.when(F.col("words") > 0, F.floor(F.col("want") / F.col("words"))).otherwise(F.lit(0))
    rest = F.col("want") - F.col("rounds") * F.col("words")
    n_blocks = F.greatest(F.ceil(F.col("words") / block_words), F.lit(1))
    rows = rows.withColumn("rounds", rounds.cast("long")).withColumn("rest", rest)
    rows = rows.withColumn("at", F.pmod(_seeded("start", "place", "shard"), n_blocks) * block_words)
    end, stop = F.col("begin") + F.col("size"), F.col("at") + F.col("rest")

    def cover(lo: Column, hi: Column) -> Column:
        return F.greatest(F.least(end, hi) - F.greatest(F.col("begin"), lo), F.lit(0))

    part = cover(F.col("at"), F.least(stop, F.col("words"))) + cover(F.lit(0), stop - F.col("words"))
    taken = F.least(F.col("rounds") * F.col("size") + part, F.lit(MAX_REPEAT) * F.col("size"))
    return rows.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", taken.cast("long").alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs as the mix has them: each document as often as its part, rounded, says.

    Whole documents, never excerpts. Rows that repeat a doc_id share one part.
    """
    part = mix(spark, docs).where("doc_id is not null and size > 0").groupBy("doc_id").agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias("times"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    out = docs.select("doc_id", row).join(part.where("times > 0"), "doc_id").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select("row.*")

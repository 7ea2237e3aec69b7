"""Places of rows in one global order, without a task that sees them all.

Rows are range-partitioned by the order and sorted within partitions; a row's
place is its number within the partition after the counts of the partitions
before. The numbered rows are written once, since a range partition computed
anew need not cut at the same rows. The order should be total: rows that tie in
all of it come in any order, and in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionflow.sources.tables import materialize

_BITS = 33  # of monotonically_increasing_id, for rows of a partition


def numbered(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """rows with their place in order, from 0."""
    tag = "__id"
    ids = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(tag, F.monotonically_increasing_id())
    ids = materialize(ids, "places")
    part = F.shiftright(tag, _BITS)
    # a row a partition
    sizes = ids.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    out = ids.withColumn("__part", part).join(before, "__part")
    return out.withColumn(name, F.col("__before") + F.col(tag).bitwiseAND(F.lit((1 << _BITS) - 1))).drop("__part", "__before", tag)


def seeded(key: str | Column, seed: int) -> list[Column]:
    """An order that is random in the seed, and the key to settle ties."""
    key = F.col(key) if isinstance(key, str) else key
    return [F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), key]


def in_batches(rows: DataFrame, size: int, *order: str | Column, name: str = "batch") -> DataFrame:
    """rows with the number, from 1, of the consecutive batch of size that each is in."""
    return numbered(rows, *order, name="__place").withColumn(name, (F.floor(F.col("__place") / size) + 1).cast("int")).drop("__place")


def disjoint(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that both have; none is well."""
    return left.select(key).join(right.select(key), key, "left_semi").distinct()


def fresh_sample(population: DataFrame, used: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n keys of the population that are not used yet, drawn by seed, with their place; the order of rows has no part in it."""
    left = population.select(key).distinct().join(used.select(key), key, "left_anti")
    return numbered(left, *seeded(key, seed)).where(F.col("place") < n)

"""Exact order statistics of groups of any size, by passes of bounded counts.

Each pass counts the values of a group by bucket, a monotone function of the
value, and goes on within the bucket that holds the wanted place, from its least
to its greatest value. The first pass's buckets are sixteenths of powers of two,
the next ones' equal parts of the range that is left; a range that has one
value left is the answer. No task, window or list sees more of a group than its
buckets, and no value leaves the executors but as a count.

Nulls are left out; NaN is greater than all others. Groups may have null keys.
Groups of nulls only, and empty tables, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionflow.sources.tables import materialize

#: Buckets of a range in all passes but the first, which has some 70,000 at most.
BUCKETS = 1 << 14
_FAR = 1 << 30


def _first(v: Column) -> Column:
    """The bucket of the first pass: sign, and log2 in sixteenths, which for doubles lies between -1074 and 1024."""
    size = F.floor((F.log2(F.abs(v)) + 1100) * 16)
    inner = F.when(v == 0, 0).when(v > 0, size).otherwise(-size)
    return F.when(F.isnan(v), _FAR + 1).when(v == float("inf"), _FAR).when(v == float("-inf"), -_FAR).otherwise(inner).cast("long")


def _later(v: Column, low: Column, high: Column) -> Column:
    """Low is in the first bucket and high in the last, so that every pass parts them."""
    return F.floor((v - low) / (high - low) * BUCKETS).cast("long")


def _chosen(counts: DataFrame, group: list[str]) -> DataFrame:
    """Of each group's buckets that which holds place k: k within it, its low and high."""
    before = F.coalesce(F.sum("count").over(W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = counts.withColumn("before", before).where("before <= k and k < before + count")
    return x.select(*group, (F.col("k") - F.col("before")).alias("k"), "low", "high")


def order_statistics(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, __n: how many values, a column for each place): the value at that place, from 0, of the group's sorted values.

    places: from the number of values to a place. rows are read once a pass, some
    four times at most.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    x = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(value).cast("double").alias("v")).where("v is not null")
    hist = materialize(x.groupBy(*keys, _first(F.col("v")).alias("bucket")).agg(F.count("*").alias("count"), F.min("v").alias("low"), F.max("v").alias("high")), "quantiles")
    n = F.sum("count").over(W.partitionBy(*keys))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), place(F.col("__n")).cast("long").alias("k")) for name, place in places.items()))
    counts = hist.withColumn("__n", n).withColumn("w", F.explode(wanted)).select(*keys, "__n", "w.name", "w.k", "bucket", "count", "low", "high")
    group = [*keys, "__n", "name"]
    state = materialize(_chosen(counts, group), "quantiles")
    done = []
    while not state.where("low < high").isEmpty():
        done.append(state.where("not low < high"))
        open_ = state.where("low < high").select(*(F.col(k).alias(f"{k}_") for k in keys), "__n", "name", "k", F.col("low").alias("from"), F.col("high").alias("to"))
        inside = (F.col("v") >= F.col("from")) & (F.col("v") <= F.col("to"))
        for k in keys:
            inside = inside & F.col(k).eqNullSafe(F.col(f"{k}_"))
        part = x.join(open_, inside)
        counts = part.groupBy(*group, "k", _later(F.col("v"), F.col("from"), F.col("to")).alias("bucket")).agg(F.count("*").alias("count"), F.min("v").alias("low"), F.max("v").alias("high"))
        state = materialize(_chosen(counts, group), "quantiles")
    for part in done:
        state = state.unionByName(part)
    out = state.groupBy(*keys, "__n").pivot("name", list(places)).agg(F.first("low"))
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), "__n", *places)


def nearest(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): the value nearest to that share of the way through the sorted values."""
    out = order_statistics(rows, by, value, {name: lambda n, q=q: F.round((n - 1) * F.lit(float(q))) for name, q in shares.items()})
    return out.drop("__n")


def linear(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): as nearest, but drawn between the two values beside the place."""
    places: dict = {}
    for i, q in enumerate(shares.values()):
        places[f"__l{i}"] = lambda n, q=q: F.floor((n - 1) * F.lit(float(q)))
        places[f"__h{i}"] = lambda n, q=q: F.ceil((n - 1) * F.lit(float(q)))
    out = order_statistics(rows, by, value, places)
    cols = []
    for i, (name, q) in enumerate(shares.items()):
        at = (F.col("__n") - 1) * F.lit(float(q))
        low, high = F.col(f"__l{i}"), F.col(f"__h{i}")
        cols.append(F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name))
    return out.select(*by, *cols)

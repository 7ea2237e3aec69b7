"""Exact quantiles, places in an order, batches, shards, the unit cache, fingerprints and the bootstrap, against brute force."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionflow.config import EngineConfig
from ionflow.constants import ADDUCTS, shift
from ionflow.functions import chemistry as C
from ionflow.operators import cache, evaluate as ev, quality as Q, quantiles, ranks, stats
from ionflow.sources import files

from tests.test_data_training import RAW, raw_row


# Quantiles
def _place(n, q):
    return math.floor((n - 1) * q + 0.5)


@pytest.mark.parametrize("buckets", [2, 1 << 14])
def test_quantiles_against_sorting(spark, monkeypatch, buckets):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rng = np.random.default_rng(4)
    groups = {
        "same": [3.25] * 50, "one": [-7.0], "signs": (rng.normal(size=301) * 10.0 ** rng.integers(-12, 12, 301)).tolist() + [0.0, -0.0], None: rng.integers(0, 5, 77).astype(float).tolist(),
        "odd": [float("inf"), float("-inf"), float("nan"), 1e308, -1e308, 5e-324, None, 2.0], "near": (1.0 + np.arange(40) * 2.0**-52).tolist(), "none": [None],
    }
    rows = [(k, v) for k, x in groups.items() for v in x]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = {"low": 0.0, "q3": 0.3, "median": 0.5, "high": 1.0}
    got = {r.g: r for r in quantiles.nearest(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups) - {"none"}
    for k, r in got.items():
        x = sorted((v for v in groups[k] if v is not None), key=lambda v: (math.isnan(v), v))
        for name, q in shares.items():
            want = x[_place(len(x), q)]
            assert r[name] == want or math.isnan(want) and math.isnan(r[name]), (k, name)
    line = {r.g: r.median for r in quantiles.linear(df.where("g <> 'odd' or g is null"), ["g"], "v", {"median": 0.5}).collect()}
    assert all(line[k] == pytest.approx(np.median([v for v in groups[k] if v is not None]), rel=1e-12) for k in line)


def test_quantiles_of_nothing(spark):
    assert quantiles.nearest(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"m": 0.5}).count() == 0
    whole = quantiles.nearest(spark.range(101).withColumn("v", F.col("id").cast("double")), [], "v", {"m": 0.5, "n": 0.99}).collect()
    assert [(r.m, r.n) for r in whole] == [(50.0, 99.0)]


# Places
def test_places_and_batches(spark):
    rows = spark.range(1000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1009))).repartition(6)
    got = {r.k: r.place for r in ranks.numbered(rows, "k").collect()}
    assert got == {k: p for p, k in enumerate(sorted(got))} and len(got) == 1000
    by = {r.k: r.batch for r in stats.batches(rows, "k", 300).collect()}
    assert all(by[k] == got[k] // 300 + 1 for k in got)
    assert {r.place for r in ranks.numbered(spark.createDataFrame([(1,)] * 5, "k int"), "k").collect()} == set(range(5))
    assert ranks.numbered(rows.limit(0), "k").count() == 0


def test_fresh_samples_are_disjoint_and_repeat(spark):
    people = spark.range(200).select(F.concat(F.lit("m"), "id").alias("k"))
    first = ranks.fresh_sample(people, people.limit(0), "k", 50, 3)
    again = ranks.fresh_sample(people.repartition(7).union(people), people.limit(0), "k", 50, 3)
    want = sorted((f"m{i}" for i in range(200)), key=lambda k: (hashlib.sha256(f"3:{k}".encode()).hexdigest(), k))[:50]
    assert [r.k for r in first.orderBy("place").collect()] == [r.k for r in again.orderBy("place").collect()] == want
    second = ranks.fresh_sample(people, first, "k", 150, 3)
    assert second.count() == 150 and ranks.disjoint(first, second, "k").isEmpty() and ranks.disjoint(first, again, "k").count() == 50


def test_stability_of_batches(spark):
    rng = np.random.default_rng(2)
    rank = [None if x < 3 else int(x) for x in rng.integers(0, 40, 100)]
    x = spark.createDataFrame([(f"m{k}", r) for k, r in enumerate(rank)], "molecule_id string, rank int")
    used = x.where("molecule_id like 'm1%'")
    out = ev.stability(x, "molecule_id", 4, 20, 9, used).collect()
    left = sorted((k for k in range(100) if not str(k).startswith("1")), key=lambda k: hashlib.sha256(f"9:m{k}".encode()).hexdigest())
    for r in out:
        own = left[20 * (r.batch - 1) : 20 * r.batch] if r.part == "batch" else left[: 20 * r.batch]
        v = [rank[k] for k in own]
        assert r.molecules == len(own) and r.candidate_recall == pytest.approx(sum(x is not None for x in v) / len(v))
        assert r.top5 == pytest.approx(sum(x is not None and x <= 5 for x in v) / len(v)) and r.mrr == pytest.approx(sum(1 / x for x in v if x) / len(v))
        assert r.mrr25 == pytest.approx(sum(1 / x for x in v if x and x <= 25) / len(v))
    assert len(out) == 8
    with pytest.raises(ValueError, match="too few"):
        ev.stability(x, "molecule_id", 5, 20, 9, used)
    sums = ev.metric_sums(x, ["molecule_id"])
    whole, plain = ev.metrics_of(ev.merged_sums(sums)).first(), ev.metrics(x).first()
    assert all(whole[c] == pytest.approx(plain[c]) for c in plain.asDict())


# Shards
def test_shards_are_merged_when_whole(spark, tmp_path):
    rows = spark.range(95).selectExpr("lpad(id, 3, '0') as k", "id").union(spark.sql("select '007', 7L"))
    files.write_shards(rows, f"{tmp_path}/s", "k", 10)
    merged = files.merge_shards(spark, f"{tmp_path}/s", f"{tmp_path}/m", "k", rows, 10)
    assert sorted(r.id for r in merged.collect()) == sorted([*range(95), 7])
    ends = spark.read.parquet(f"{tmp_path}/m").groupBy(F.input_file_name().alias("f")).agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("f").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))
    none = dict.fromkeys(("missing", "unknown", "in_several", "out_of_order", "other_size"), 0)
    shards = spark.read.parquet(f"{tmp_path}/s")
    assert files.shard_faults(shards, rows, "k", 10) == none
    assert files.shard_faults(shards.where("shard <> 3"), rows, "k", 10) == none | {"missing": 10}
    assert files.shard_faults(shards, rows.where("id < 90"), "k") == none | {"unknown": 5}
    twice = shards.union(shards.where("shard = 0").withColumn("shard", F.lit(12)))
    assert files.shard_faults(twice, rows, "k") == none | {"in_several": 10, "out_of_order": 1}
    with pytest.raises(ValueError, match="5 unknown"):
        files.merge_shards(spark, f"{tmp_path}/s", f"{tmp_path}/m2", "k", rows.where("id < 90"))


# Cache
def test_a_stopped_cache_goes_on_where_it_was(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "cast(id % 7 as int) as bucket").where("bucket <> 2 or id < 0").union(spark.sql("select 1000L, 2"))
    asked = []

    def compute(part, die=None):
        own = sorted(r.bucket for r in part.select("bucket").distinct().collect())
        if die is not None and die in own:
            raise RuntimeError("killed")
        asked.extend(own)
        return part.where("bucket <> 2").withColumn("twice", F.col("id") * 2)  # bucket 2 has no rows

    one = {"data": "x", "limit": None}
    store = cache.UnitCache(spark, f"file://{tmp_path}", one)
    with pytest.raises(RuntimeError):
        store.fill(rows, lambda p: compute(p, 5), at_once=2)
    assert asked == [0, 1, 2, 3] and {r.unit: r.rows for r in store.log().collect()} == {0: 15, 1: 15, 2: 0, 3: 14}
    # written, but not in the log: is computed again and replaced
    spark.createDataFrame([(99, 4, 0, 4)], "id long, bucket int, twice long, unit int").write.partitionBy("unit").mode("append").parquet(f"{store.path}/rows")
    asked.clear()
    steps = []
    again = cache.UnitCache(spark, f"file://{tmp_path}", {"limit": None, "data": "x"})
    out = again.fill(rows, compute, at_once=2, told=lambda a, b: steps.append((a, b)))
    assert asked == [4, 5, 6] and steps == [(2, 3), (3, 3)]
    assert sorted((r.id, r.twice) for r in out.collect()) == [(k, 2 * k) for k in range(100) if k % 7 != 2]
    asked.clear()
    assert again.fill(rows, compute).count() == out.count() and asked == []
    for other in ({"data": "y", "limit": None}, {"data": "x", "limit": 5}, {"data": "x"}):
        new = cache.UnitCache(spark, f"file://{tmp_path}", other)
        assert new.path != store.path and new.log().isEmpty()
    empty = cache.UnitCache(spark, f"file://{tmp_path}", {"data": "none"})
    assert empty.fill(rows.limit(0), compute).columns == ["id", "bucket", "twice"]


def test_training_goes_on_with_the_features_it_has(spark, tmp_path, monkeypatch):
    rows = []
    for i in range(60):
        formula = ("C6H12O6", "C5H10O5")[i % 2]
        rows.append(raw_row(f"T{i}", formula, C.mass_of(C.parse(formula)) + shift(ADDUCTS[0][1], 1)))
    spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(str(tmp_path / "raw"))
    Q.prepare(spark, str(tmp_path / "raw"), str(tmp_path / "p"), EngineConfig(precursor_ppm=1000.0), buckets=3)
    from ionflow.engine import FormulaEngine

    calls, inner = [], FormulaEngine.candidate_features

    def counted(self, part):
        calls.append(1)
        return inner(self, part)

    def stopped(*a, **k):
        raise KeyboardInterrupt

    monkeypatch.setattr(FormulaEngine, "candidate_features", counted)
    monkeypatch.setattr(ev.ranking, "fit", stopped)
    args = (spark, str(tmp_path / "p"), str(tmp_path / "m"), 20, 5)
    with pytest.raises(KeyboardInterrupt):
        ev.train(*args, rounds=3)
    made = len(calls)
    assert made >= 2 and not os.path.exists(tmp_path / "m" / "model.json")
    monkeypatch.undo()
    monkeypatch.setattr(FormulaEngine, "candidate_features", counted)
    meta = ev.train(*args, rounds=3)
    assert len(calls) == made + 1 and meta["groups"] > 0  # the baseline's alone


# Fingerprints
def test_marks_of_content(spark, tmp_path, monkeypatch):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/a")
    one = next(f"{tmp_path}/a/{n}" for n in sorted(os.listdir(f"{tmp_path}/a")) if n.endswith(".parquet"))
    whole = hashlib.sha256(open(one, "rb").read()).hexdigest()
    assert files.mark(one) == whole[:16] == files.mark(f"file://{one}")
    a = files.mark(f"{tmp_path}/a")
    os.rename(f"{tmp_path}/a", f"{tmp_path}/b")
    assert files.mark(f"{tmp_path}/b") == files.mark(f"file://{tmp_path}/b") == a
    monkeypatch.setattr(files, "_WHOLE", 10)  # streamed
    assert files.mark(f"{tmp_path}/b") == a
    os.rename(one.replace("/a/", "/b/"), f"{tmp_path}/b/part-new.parquet")
    assert files.mark(f"{tmp_path}/b") != a


# Bootstrap
def test_poisson_bootstrap_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(f"m{rng.integers(60)}", f"s{rng.integers(3)}", None if rng.random() < 0.1 else float(rng.random())) for _ in range(200)] + [(None, "s1", 1.0), ("m1", None, 1.0)]
    priors = {"s0": 0.5, "s1": 0.3, "s2": 0.2}
    p, ends = 2**31 - 1, [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * (2**31 - 1)) for k in range(16)]

    def number(text):
        return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16) % p

    want = {}
    for rep in range(1, 26):
        c = [number(f"{rep}:{j}") for j in range(4)]
        by = {}
        for key, source, value in rows:
            if key is None or source is None or value is None:
                continue
            h = number(key)
            z = (c[3] * h**3 + c[2] * h**2 + c[1] * h + c[0]) % p
            w = sum(e <= z for e in ends if e < p)
            x = by.setdefault(source, [0.0, 0])
            x[0] += w * value
            x[1] += w
        want[rep] = sum(priors[s] * x / n for s, (x, n) in by.items() if n)
    df = spark.createDataFrame(rows, "molecule_id string, source string, value double").repartition(5)
    got = {r.rep: r["mean"] for r in stats.poisson_bootstrap(df, spark.createDataFrame(list(priors.items()), "source string, prior double"), "value", 25).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_poisson_weights_are_poisson():
    w = stats.poisson_weights(np.arange(1, 4001) * 524287 % stats.PRIME, stats._coefficients(500)).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01
    assert abs((w == 0).mean() - math.exp(-1)) < 0.005 and abs((w == 2).mean() - math.exp(-1) / 2) < 0.005
    assert abs(np.corrcoef(w[:200])[np.triu_indices(200, 1)].mean()) < 0.01

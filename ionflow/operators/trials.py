"""Trials of settings of the learned ranker, one a task over the same rows, and a fixed rule to choose by.

The training rows are bounded by their selection (molecules times 256 rows at
most); they are broadcast once, after a check of their size, and every trial
reads them there. A trial has its own seed and no part in others, so that trials
side by side give the trees of trials one after the other. Results are rows of a
table: a trial that is there under the same name, settings and rows is not run
again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ionflow.operators import cache, ranking, stats
from ionflow.sources import tables

#: Bytes of rows that may be broadcast.
BROADCAST = 1 << 30
#: What a trial can set, beside rounds.
SETTINGS = ("leaves", "rate", "least", "l2", "truncation", "feature_share", "row_share", "patience", "rounds", "seed")
_RESULT = "unit int, name string, settings string, trees int, mrr25 double, top1 double, model string"


def _digest(parts) -> str:
    h = hashlib.sha256()
    for x in parts:
        h.update(np.ascontiguousarray(x).tobytes())
    return h.hexdigest()


def _scores(model: ranking.Ranker, valid, groups: int) -> tuple[float, float]:
    """MRR@25 and top-1 share of a model."""
    x, y, sizes = valid
    out = ranking.Packed(model).predict(np.asarray(x, np.float32))
    return ranking.mrr(out, y, sizes, groups=groups), ranking.mrr(out, y, sizes, k=1, groups=groups)


def run(spark: SparkSession, train, valid, trials: dict[str, dict], root: str, valid_groups: int | None = None) -> DataFrame:
    """(name, settings, trees, mrr25, top1, model) of each trial; train and valid: (features, labels, group sizes).

    trials: settings of ranking.fit by name. valid_groups counts groups without rows too.
    """
    for name, own in trials.items():
        if unknown := set(own) - set(SETTINGS):
            raise ValueError(f"trial {name}: unknown settings {sorted(unknown)}")
    train, valid = (tuple(np.asarray(a) for a in x) for x in (train, valid))
    if (size := sum(a.nbytes for a in (*train, *valid))) > BROADCAST:
        raise ValueError(f"{size} bytes of rows are too many to broadcast; select fewer molecules")
    tables.ship(spark)
    groups = len(valid[2]) if valid_groups is None else valid_groups
    shared = spark.sparkContext.broadcast((train, valid))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                rows, held_out = shared.value
                model = ranking.fit(*rows, valid=held_out, valid_groups=groups, **json.loads(row["settings"]))
                mrr25, top1 = _scores(model, held_out, groups)
                made = (row["unit"], row["name"], row["settings"], len(model.trees), mrr25, top1, json.dumps(model.to_dict()))
                yield pa.record_batch([pa.array([v]) for v in made], names=[c.split()[0] for c in _RESULT.split(", ")]).cast(_arrow())

    # a trial is known by its settings and rows, whatever the others are
    rows = [(int(hashlib.sha256(f"{n}:{json.dumps(s, sort_keys=True)}".encode()).hexdigest()[:7], 16), n, json.dumps(s, sort_keys=True)) for n, s in trials.items()]
    asked = spark.createDataFrame(rows, "unit int, name string, settings string")
    done = cache.UnitCache(spark, root, {"rows": _digest((*train, *valid)), "groups": groups})

    def compute(part: DataFrame) -> DataFrame:
        return part.repartition(len(rows), "unit").mapInArrow(fitted, _RESULT)

    out = done.fill(asked.withColumn("trial", F.col("unit")), lambda p: compute(p).withColumn("trial", F.col("unit")), unit="trial", at_once=len(rows) or 1)
    return out.drop("trial").join(asked.select("name", "settings"), ["name", "settings"])


def _arrow() -> pa.Schema:
    kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _RESULT.split(", ")])


def select(results: DataFrame, incumbent: tuple[str, ranking.Ranker, float, float] | None = None) -> tuple[str, ranking.Ranker]:
    """The best of the trials and the incumbent (name, model, mrr25, top1): MRR@25, top-1, fewer trees, name. Test rows have no part in it."""
    rows = results.select("name", "trees", "mrr25", "top1", "model")
    if incumbent is not None:
        name, model, mrr25, top1 = incumbent
        rows = rows.unionByName(results.sparkSession.createDataFrame([(name, len(model.trees), mrr25, top1, json.dumps(model.to_dict()))], rows.schema))
    best = stats.select_model(rows).first()
    return best.name, ranking.Ranker.from_dict(json.loads(best.model))

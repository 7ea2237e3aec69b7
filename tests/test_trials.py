"""Trials side by side against trials one after the other, what is run again, and the rule of choice."""

import json

import numpy as np
import pytest

from ionflow.operators import ranking, trials
from ionflow.operators.features import FEATURES


def _rows(seed, groups=30, size=20):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups * size, len(FEATURES))).astype(np.float32)
    y = np.zeros(len(x))
    for g in range(groups):
        y[g * size + np.argmax(x[g * size : (g + 1) * size, 3] + 0.5 * x[g * size : (g + 1) * size, 9])] = 1
    return x, y, np.full(groups, size)


SETS = {
    "plain": {"rounds": 6}, "small": {"leaves": 5, "rounds": 6}, "slow": {"rate": 0.025, "rounds": 6}, "regular": {"least": 50, "l2": 1.0, "rounds": 6},
    "shares": {"feature_share": 0.5, "row_share": 0.7, "rounds": 6}, "top": {"truncation": 3, "rounds": 6}, "same": {"rounds": 6}, "seeded": {"feature_share": 0.5, "seed": 1, "rounds": 6},
}


def test_trials_side_by_side_give_the_trees_of_trials_in_turn(spark, tmp_path, monkeypatch):
    train, valid = _rows(1), _rows(2, 12)
    out = {r.name: r for r in trials.run(spark, train, valid, SETS, f"file://{tmp_path}", 15).collect()}
    assert set(out) == set(SETS)
    for name, own in SETS.items():
        model = ranking.fit(*train, valid=valid, valid_groups=15, **own)
        assert json.loads(out[name].model)["trees"] == json.loads(json.dumps(model.to_dict()))["trees"]
        assert out[name].trees == len(model.trees) and out[name].mrr25 == pytest.approx(model.meta["validation_mrr25"], abs=1e-12)
    assert len({out[n].model for n in SETS}) == len(SETS) - 1  # plain and same
    # the same trials are not run again; new ones are
    monkeypatch.setattr(ranking, "fit", None)
    again = trials.run(spark, train, valid, SETS, f"file://{tmp_path}", 15)
    assert {r.name: r.model for r in again.collect()} == {n: r.model for n, r in out.items()}
    part = trials.run(spark, train, valid, {"slow": SETS["slow"]}, f"file://{tmp_path}", 15)
    assert [r.name for r in part.collect()] == ["slow"]
    best, model = trials.select(again)
    want = sorted(out.values(), key=lambda r: (-r.mrr25, -r.top1, r.trees, r.name))[0]
    assert best == want.name and model.to_dict()["trees"] == json.loads(want.model)["trees"]
    kept = ranking.Ranker([], 0.1)
    assert trials.select(again, ("incumbent", kept, 2.0, 0.0))[0] == "incumbent" and trials.select(again, ("incumbent", kept, 0.0, 0.0))[0] == best


def test_trials_are_checked(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError, match="unknown settings"):
        trials.run(spark, _rows(1), _rows(2), {"a": {"leafs": 3}}, str(tmp_path))
    monkeypatch.setattr(trials, "BROADCAST", 10)
    with pytest.raises(ValueError, match="too many"):
        trials.run(spark, _rows(1), _rows(2), {"a": {}}, str(tmp_path))

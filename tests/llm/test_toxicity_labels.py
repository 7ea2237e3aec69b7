"""Token labels of the toxicity model where toxic labels are few."""

import numpy as np
import pyarrow as pa

from ionflow.llm import toxicity_crf as tox


def test_few_labels_still_give_a_model():
    """Four toxic documents of sixty, two by two with a word of their own."""
    rng = np.random.default_rng(2)
    words = np.array([f"{a}{b}" for a in ("al", "be", "co", "du", "er", "fa") for b in ("ra", "mi", "to", "nu", "so", "le", "ki")])
    texts = [" ".join(rng.choice(words, 60)) for _ in range(80)]
    for k in (0, 1, 76, 77):
        texts[k] += " nastyword"
    for k in (2, 3, 78, 79):
        texts[k] += " vilething"
    toxic = np.array([int(k < 4) for k in range(60)])
    model = tox.train(pa.array(texts[:60]), toxic)
    assert model["w"] is not None
    rows = pa.record_batch([pa.array(range(20)), pa.array(texts[60:])], names=["key", "text"])
    score = np.concatenate([b.column("score").to_numpy() for b in tox._scorer(model)(iter([rows]))])
    assert (score >= tox.THRESHOLD).tolist() == [False] * 16 + [True] * 4

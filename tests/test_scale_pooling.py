"""Pooling moves a vector once to a group of samples, not once for each of their tokens."""

import random
from collections import Counter

import pytest

from scribeprint.operators import vectors


def test_pooled_means_are_those_of_all_tokens(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    table = [(w, [rng.random() for _ in range(3)]) for w in words[:30]]
    table += [("w0", [1.0, 2.0, 3.0]), ("w31", None), ("unused", [9.0, 9.0, 9.0])]  # one with two vectors, one with none
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 50)))) for k in range(80)]
    rows += [(7, "w1 w1"), (None, "w2"), (None, "w3"), (200, None), (201, "other")]
    own = {}
    for k, t in rows:
        own.setdefault(k, Counter()).update((t or "").split())
    want = {}
    for k, n in own.items():
        hits = [(c, v) for w, c in n.items() for t, v in table if t == w and v]
        want[k] = [sum(c * v[i] for c, v in hits) / sum(c for c, _ in hits) for i in range(3)] if hits else None
    monkeypatch.setattr(vectors, "GROUP_BYTES", 300)
    monkeypatch.setattr("scribeprint.operators.pooling.SLICE", 60)
    found = vectors.pool_tokens(spark.createDataFrame(rows, "sample_id long, code string"),
                                spark.createDataFrame(table, "token string, vector array<double>"))
    got = found.collect()
    assert Counter(r["sample_id"] for r in got) == Counter(k for k, _ in rows)
    for r in got:
        assert r["embedding"] is want[r["sample_id"]] or r["embedding"] == pytest.approx(want[r["sample_id"]])
    assert "aggregate_metrics" not in found._jdf.queryExecution().executedPlan().toString()

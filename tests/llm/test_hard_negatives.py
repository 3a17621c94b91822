"""Hard negatives by score windows from Hilbert-ordered blocks."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from scribeprint.llm import hard_negatives as hard

KIND = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2), (2, 1), (1, 4)])
def test_the_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in hard.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=lambda k: keys[k])]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def rows_of(n=400, dims=6):
    rng = random.Random(9)
    centers = [[rng.uniform(-0.3, 0.5) for _ in range(dims)] for _ in range(4)]
    rows = []
    for k in range(n):
        c = rng.randrange(4)
        rows.append((k - 100, [x + rng.gauss(0, 0.1) for x in centers[c]], (c + (rng.random() < 0.2)) % 4))
    rows += [(1000 + k, rows[7][1], k % 2) for k in range(40)]                    # one vector, many times
    rows += [(2000 + k, [0.5] * 3, k % 3) for k in range(0, 300, 50)]             # another length
    rows += [(3000, [], 1), (3001, [], 1), (3002, [], 2), (3100, None, 1), (3200, rows[3][1], None)]
    rows += [(3300, [float("nan")] * dims, 1), (3400, [float("inf")] + [0.0] * (dims - 1), 1), (3500, [None] * dims, 1)]
    return rows + [(None, rows[9][1], 3), (None, rows[9][1], 1), (3600, [0.0] * dims, 2)]


def stored(rows):
    """The components as floats of 32 bits, as the table has them."""
    return [(i, v and [x if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16, "area_rows": 64, "group_rows": 3}])
def test_equals_brute_force(spark, sizes):
    rows = rows_of()
    df = spark.createDataFrame(rows, KIND).withColumns(
        {c: F.lit(7) for c in ("id", "v", "area", "block", "a.b", "c`d")}).repartition(5)
    expected = brute.hard_negatives(stored(rows), every=20)
    assert result(hard.mine(df, every=20, **sizes)) == expected and len(expected) > 200


def test_repeated_rows_and_empty_tables(spark):
    rows = rows_of(60) + [(20, [0.1] * 6, 1)] * 3
    df = spark.createDataFrame(rows, KIND)
    assert result(hard.mine(df, every=20, block_rows=8, group_rows=2)) == brute.hard_negatives(stored(rows), every=20)
    assert hard.mine(df.filter("false")).count() == 0
    assert hard.mine(df.filter("vec_id = 21")).count() == 0


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-4e5, 4e5) for _ in range(5)], k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(hard.mine(df, every=10)) == brute.hard_negatives(rows, every=10)


def test_bounds_leave_blocks_out():
    """Clusters far apart: blocks of other clusters are not read."""
    rng = np.random.default_rng(4)
    v = rng.integers(90, 110, (64, 8)) * np.repeat([1, -1], 32)[:, None]
    own = hard._Windows(np.array([1]), v[:1], np.array([[1]]), np.array([[hard._NO_LIMIT]]), 3)
    for part in (v[1:32], v[32:]):
        own.add(np.arange(100, 100 + len(part)), part, part.min(0).astype(float), part.max(0).astype(float))
    assert (own.read, own.skipped) == (1, 1)
    best = sorted((-int(v[0] @ x), 100 + k) for k, x in enumerate(v[1:32]))[:3]
    assert [(-s, i) for s, i in zip(own.score[0, 0], own.found[0, 0])] == best

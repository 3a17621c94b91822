"""Importance resampling by array-scored weights and a distributed radix sort."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from scribeprint.llm import radix_resampling as radix
from scribeprint.llm.scratch import written

KIND = "doc_id long, text string"


def rows_of(n=80):
    rng = random.Random(5)
    voc = ["alpha", "Beta", "GAMMA", "delta", "é", "x1", "zeta"]
    rows = [(k - 20, " ".join(rng.choices(voc, k=rng.randrange(0, 60)))) for k in range(n)]
    rows += [(500, rows[30][1])] * 5                                 # one row, five times
    rows += [(600 + k, "alpha beta " * 15) for k in range(20)]       # equal weights
    return rows + [(None, "alpha " * 30), (None, None), (700, None), (701, ""), (702, "!! \n"), (703, "word " * 200_000)]


TARGET = ["alpha beta alpha", None, "", "É zeta"]


@pytest.mark.parametrize("low, high", [(1, 1), (1, 3), (2, 2)])
def test_equals_brute_force(spark, low, high):
    rows = rows_of()
    docs = spark.createDataFrame(rows, KIND).withColumns(
        {c: F.lit(7) for c in ("buckets", "id_", "place", "key", "n_words", "rank", "a.b", "c`d")}).repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = radix.resample_to_target(docs, target, chunk=16, digit_bits=8, low=low, high=high, buckets=997)
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    expected = brute.target_resampling(rows, TARGET, 997, low, high)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    # Ranks are those of the order by score and id; equal rows may take each other's.
    ranks = lambda rows: sorted((r[5], r[4], str(r[0])) for r in rows if r[5] is not None)
    assert ranks(found) == ranks(expected) and len(ranks(found)) > 5


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], KIND), spark.createDataFrame([("a b",)], "text string")
    assert radix.resample_to_target(none, target).count() == 0
    docs = spark.createDataFrame([(1, "a b c " * 10), (2, "a")], KIND)
    got = radix.resample_to_target(docs, target.filter("false"), percent=100).collect()
    assert sorted((r["doc_id"], r["rank"]) for r in got) == [(1, 1), (2, None)]


@pytest.mark.parametrize("bits, chunk", [(11, 8), (16, 1 << 18)])
def test_radix_sort_is_a_stable_sort(spark, bits, chunk):
    rng = random.Random(2)
    rows = [(rng.choice([-5, 0, 3, 1 << 40, -(1 << 63), (1 << 63) - 1]), rng.randrange(-3, 3), k) for k in range(300)]
    df = written(spark.createDataFrame(rows, "a long, b long, row long").repartition(4).withColumn(
        "place", F.monotonically_increasing_id()), "rows")
    before = {r["row"]: r["place"] for r in df.collect()}
    got = radix.radix_sort(df, ("a", True), ("b", False), bits=bits, chunk=chunk).collect()
    order = [r["row"] for r in sorted(got, key=lambda r: r["place"])]
    assert sorted(r["place"] for r in got) == list(range(300))
    assert order == [r[2] for r in sorted(rows, key=lambda r: (-r[0], r[1], before[r[2]]))]


def test_equal_keys_are_cut_into_chunks(spark):
    df = spark.range(1000, numPartitions=3).select(F.lit(4).cast("long").alias("a"), F.col("id").alias("row")).withColumn(
        "place", F.monotonically_increasing_id())
    got = radix.radix_sort(df, ("a", False), chunk=16)
    assert sorted(r["place"] for r in got.collect()) == list(range(1000))

import random

import pytest
from pyspark.sql import functions as F

from scribeprint.operators.training_log import best_step, epoch_pairs, with_blocks
from scribeprint.schema import TRAINING_LOG


def by_loop(lines):
    """What a callback that is told one line after the other would print."""
    known, printed = {}, []
    for seq, epoch, loss, rate, eval_loss in sorted(lines):
        if epoch is None:
            continue
        if loss is not None:
            known[epoch] = (loss, rate)
        if eval_loss is not None and epoch in known:
            printed.append((seq, epoch, known[epoch][0], eval_loss, known[epoch][1]))
    return printed


@pytest.mark.parametrize("block", [1, 3, 16, 1 << 20])
def test_pairs_equal_a_loop(spark, block):
    rng = random.Random(block)
    maybe = lambda p: round(rng.random(), 3) if rng.random() < p else None
    lines = [(i, rng.choice([0.25, 0.5, 0.5, 0.5, 1.0, None]), maybe(0.2), maybe(0.5), maybe(0.4))
             for i in range(200)]
    rng.shuffle(lines)
    got = epoch_pairs(spark.createDataFrame(lines, TRAINING_LOG), block).collect()
    assert sorted(map(tuple, got)) == by_loop(lines)


def test_blocks_are_even_whatever_the_gaps(spark):
    """Line numbers with gaps of a billion, and one epoch with nearly all lines."""
    lines = spark.range(60_000).select(
        (F.col("id") * 1_000_000_000 + F.hash("id") % 1000).alias("seq"),
        F.when(F.col("id") % 1000 == 0, 2.0).otherwise(1.0).alias("epoch"), F.lit(0.5).alias("loss"))
    sizes = with_blocks(lines, 500).groupBy("epoch", "__block").agg(
        F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).collect()
    assert max(r["n"] for r in sizes) < 1_000 and sum(r["n"] for r in sizes) == 60_000
    spans = sorted((r["__block"], r["low"], r["high"]) for r in sizes if r["epoch"] == 1.0)
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:])) and len(spans) > 100


def test_eval_before_loss_gives_nothing(spark):
    lines = [(1, 1.0, None, None, 0.5), (2, 1.0, 0.4, 0.1, None), (3, 2.0, 0.3, 0.1, 0.6)]
    got = epoch_pairs(spark.createDataFrame(lines, TRAINING_LOG)).collect()
    assert [tuple(r) for r in got] == [(3, 2.0, 0.3, 0.6, 0.1)]


def test_best_step_takes_the_earliest_of_equals(spark):
    lines = [(5, 2.0, None, None, 0.2), (3, 1.0, None, None, 0.2), (4, 1.5, None, None, 0.3),
             (1, 0.5, 0.1, 0.1, None)]
    df = spark.createDataFrame(lines, TRAINING_LOG)
    assert tuple(best_step(df).first()) == (3, 1.0, 0.2)
    assert best_step(df.filter("seq = 1")).count() == 0

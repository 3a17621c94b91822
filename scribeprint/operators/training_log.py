"""Training logs: pairing train and eval lines of one epoch, and the best step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribeprint.operators.lookup import lookup_join

#: Lines of an epoch that are searched together, about, and blocks of an epoch at most: 64 cuts of 64.
BLOCK, FAN = 1 << 20, 64


def with_blocks(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lines`` with ``__block``: stretches of about ``block`` lines of an epoch, numbered in order of ``seq``.

    The cuts are quantiles of the line numbers that an epoch has, so gaps between them do not matter. Up to
    ``FAN`` squared blocks are made of an epoch; of a longer one they have more lines. Only the number of
    lines of the longest epoch comes to the driver.
    """
    longest = lines.groupBy("epoch").count().agg(F.max("count")).first()[0] or 0
    n_blocks = min(-(-longest // block), FAN * FAN)
    if n_blocks <= 1:
        return lines.withColumn("__block", F.lit(0))
    shares = [k / n_blocks for k in range(1, n_blocks)]
    cuts = F.percentile_approx("seq", shares, 20 * n_blocks)
    coarse = F.filter("__cuts", lambda c, k: k % FAN == FAN - 1)
    known = lookup_join(lines, lines.groupBy("epoch").agg(cuts.alias("__cuts")), ["epoch"])
    passed = lambda xs: F.size(F.filter(xs, lambda c: c < F.col("seq")))
    # A line looks at the cuts of its stretch only.
    known = known.withColumn("__stretch", passed(coarse) * FAN)
    near = F.slice("__cuts", F.col("__stretch") + 1, F.lit(FAN))
    return known.withColumn("__block", F.col("__stretch") + passed(near)).drop("__cuts", "__stretch")


def epoch_pairs(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per eval line whose epoch already has a training loss (on that line or earlier).

    ``log`` has ``seq`` (a unique line number), ``epoch``, ``loss``,
    ``learning_rate`` and ``eval_loss``; the last three may be null. The loss and
    the learning rate are those of the latest training line of the same epoch.

    An epoch may hold most of the lines, so the search runs inside blocks of about
    ``block`` lines, which bound the rows of a window; what a block
    takes over from earlier ones is looked up in a summary of one row per block.
    """
    useful = F.col("epoch").isNotNull() & (F.col("loss").isNotNull()
                                           | F.col("eval_loss").isNotNull())
    lines = with_blocks(log.filter(useful), block)
    is_train = F.col("loss").isNotNull()
    inside = (Window.partitionBy("epoch", "__block").orderBy("seq")
                    .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    train = F.when(is_train, F.struct("loss", "learning_rate"))
    latest = lines.withColumn("__here", F.last(train, ignorenulls=True).over(inside))

    # Every block has a row here; __last is null where it holds no training line.
    blocks = lines.groupBy("epoch", "__block").agg(F.max_by(
        F.struct("loss", "learning_rate"), F.when(is_train, F.col("seq"))).alias("__last"))
    earlier = (Window.partitionBy("epoch").orderBy("__block")
                     .rowsBetween(Window.unboundedPreceding, -1))
    carried = blocks.select("epoch", "__block",
                            F.last("__last", ignorenulls=True).over(earlier).alias("__before"))
    paired = (latest.filter(F.col("eval_loss").isNotNull())
                    .join(carried, ["epoch", "__block"], "left")
                    .withColumn("__train", F.coalesce("__here", "__before"))
                    .filter(F.col("__train").isNotNull()))
    return paired.select("seq", "epoch", F.col("__train.loss").alias("loss"), "eval_loss",
                         F.col("__train.learning_rate").alias("learning_rate"))


def best_step(log: DataFrame) -> DataFrame:
    """The eval line with the least ``eval_loss``; the earliest one on a tie."""
    best = F.min_by(F.struct("seq", "epoch", "eval_loss"), F.struct("eval_loss", "seq"))
    return (log.filter(F.col("eval_loss").isNotNull()).agg(best.alias("b"))
               .filter(F.col("b").isNotNull()).select("b.*"))

"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeprint.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` for every id in the edges ``a, b``: ids are connected if their labels are equal.

    In each round every id takes the least id that it or its neighbours know, and then that id's own; edges
    become edges of labels, and those that close on themselves go. A chain halves in a round, a star is
    done in one. Each round is written, so a lost executor repeats a round at most.
    """
    edges = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(
            edges.select(F.col("b").alias("id"), F.col("a").alias("other")))
        near = written(both.groupBy("id").agg(F.min("other").alias("least"))
                       .select("id", F.least("id", "least").alias("near")), "neighbours")
        next_ = near.select(F.col("id").alias("near"), F.col("near").alias("label"))
        step = written(near.join(next_, "near").select("id", "label"), "steps")
        if labels is None:
            labels = step
        else:
            moved = step.select(F.col("id").alias("label"), F.col("label").alias("to"))
            labels = written(labels.join(moved, "label", "left").select(
                "id", F.coalesce("to", "label").alias("label")), "labels")
        of = lambda side: step.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"))
        edges = written(edges.join(of("a"), "a").join(of("b"), "b").filter("a_label <> b_label")
                        .select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")) if labels is None else labels

"""Table layouts shared by sources and operators."""

from __future__ import annotations

from pyspark.sql import types as T

HUMAN, AI = 0, 1

SAMPLES = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("ai", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

# One row per tree node. pre and post are the 0-based preorder and postorder
# ranks inside the sample, so a lies above d when a.pre < d.pre and a.post > d.post.
NODES = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("pre", T.IntegerType()),
    T.StructField("post", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("n_children", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("start_byte", T.IntegerType()),
    T.StructField("end_byte", T.IntegerType()),
])

SCORES = "sample_id string, model string, p0 double, p1 double"
PREDICTIONS = "config string, model string, sample_id string, y_true int, y_pred int"
TRAINING_LOG = "seq bigint, epoch double, loss double, learning_rate double, eval_loss double"

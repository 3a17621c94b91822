"""The stateless parts on unbounded input: cleaning, label checks, features and linear scores.

None of them looks at more than one row, so the batch functions are used as
they are and no state, watermark or late-data rule is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scribeprint.functions.labels import enforce
from scribeprint.functions.scoring import argmax2, linear_probability
from scribeprint.functions.structure import feature_array, with_structural_features
from scribeprint.sources.readers import parse_json_lines


def read_jsonl_stream(spark: SparkSession, folder: str, language: str,
                      policy: str = "drop") -> DataFrame:
    """Samples from JSON-lines files as they arrive. The id is the file and a hash of the line,
    since a stream has no row positions that hold over restarts."""
    lines = spark.readStream.text(folder).select(
        F.concat_ws(":", F.col("_metadata.file_name"), F.md5("value")).alias("sample_id"), "value")
    return enforce(parse_json_lines(lines, language), policy)


def score_samples(samples: DataFrame, weights: Sequence[float], intercept: float) -> DataFrame:
    """Structural features of ``code`` and the class of a linear model with known weights."""
    features = with_structural_features(samples, "code")
    p1 = linear_probability(feature_array(), weights, intercept)
    scored = features.withColumn("p1", p1).withColumn("p0", 1 - F.col("p1"))
    return scored.withColumn("y_pred", argmax2(F.col("p0"), F.col("p1")))


def write_stream(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored samples to a Parquet folder; each input file is taken in exactly once."""
    return (scored.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())

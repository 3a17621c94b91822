"""Dense vectors: pooling, scaling, text embeddings, and joining them with features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scribeprint.functions.structure import FEATURES, feature_array
from scribeprint.operators.encoding import text_tokens
from scribeprint.operators.lookup import lookup_join
from scribeprint.operators.pooling import bundled_vectors, counted_words, group_words, pooled_means
from scribeprint.session import importable, partition_keys, size_tasks


def as_vector(array: Column) -> Column:
    return array_to_vector(array.cast("array<double>"))


def mean_pool(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """The plain mean of the vectors of each group. Sums are added up before the shuffle."""
    mean = Summarizer.mean(as_vector(F.col(vector)))
    return (vectors.filter(F.col(vector).isNotNull()).groupBy(by)
                   .agg(vector_to_array(mean).alias("mean")))


def train_token_vectors(texts: DataFrame, text: str = "code", size: int = 64, window: int = 5, min_count: int = 5,
                        iterations: int = 1, seed: int = 42, partitions: int = 1) -> DataFrame:
    """``token, vector``: a table of vectors trained on the tokens of the texts (skip-gram).

    The table has one row per token seen ``min_count`` times or more. With one partition training is repeatable for a
    seed: texts are ordered by their hash first. More ``partitions`` train side by side and are averaged; the order in
    which Spark adds them up, and orders tokens of equal counts, may then change from run to run, so store the table.
    """
    words = texts.select(text_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    key = F.xxhash64("tokens")
    dealt = words.repartition(partitions, key).sortWithinPartitions(key)
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=iterations, seed=seed,
                     numPartitions=partitions, inputCol="tokens").fit(dealt)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector", "float32").alias("vector"))


#: Bytes of text of a group of samples, about.
GROUP_BYTES = 3 << 25


def pool_tokens(samples: DataFrame, token_vectors: DataFrame, text: str = "code",
                id_col: str = "sample_id") -> DataFrame:
    """``id_col, embedding``: the plain mean of the vectors of all tokens of a sample that have one.

    A sample without any has a null embedding. The
    table of vectors has as many rows as the vocabulary, so neither it nor a vector for each token of a sample is
    moved: samples are dealt to groups by their ids, and a vector is moved once to each group that has its token. The
    larger a group, the fewer vectors are moved: most of a task's memory is for those of one group. What is dealt is each
    sample's different tokens with their counts, once, and vectors in compressed bundles. The text is measured when this is called, so that groups stay as
    large as they are however many samples there are.
    """
    spark = samples.sparkSession
    n_groups = size_tasks(samples, text, GROUP_BYTES)
    keys = F.array(*map(F.lit, partition_keys(spark, n_groups)))
    group = F.get(keys, F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_groups)).cast("int"))
    own, wide = samples.schema[id_col], T.ArrayType(T.DoubleType())
    of = T.StructField("__group", T.IntegerType())
    moved = T.StructType([of, own, T.StructField("words", T.StringType()), T.StructField("counts", T.BinaryType())])
    asked = T.StructType([of, T.StructField("token", T.StringType())])
    bundle = T.StructType.fromDDL("__of int, words string, n int, size int, vectors binary")
    made = T.StructType([own, T.StructField("embedding", wide)])
    moved_arrow, asked_arrow, bundle_arrow, made_arrow = map(to_arrow_schema, (moved, asked, bundle, made))
    importable(spark)
    tokens = samples.select(group.alias("__group"), F.col(id_col), text_tokens(F.col(text)).alias("tokens"))
    dealt = tokens.mapInArrow(lambda batches: counted_words(batches, moved_arrow), moved).repartition(n_groups, "__group")
    # Both readers of what is dealt take all of its columns, so it is dealt once.
    wanted = dealt.mapInArrow(lambda batches: group_words(batches, asked_arrow), asked).withColumnRenamed("__group", "__of")
    narrow = dict(token_vectors.dtypes)["vector"] == "array<float>"
    vector = F.col("vector") if narrow else F.col("vector").cast(wide)
    sent = wanted.join(token_vectors.filter(F.col("vector").isNotNull()).select("token", vector.alias("vector")), "token").select(
        "__of", "token", "vector").mapInArrow(lambda batches: bundled_vectors(batches, bundle_arrow), bundle)
    return dealt.groupBy("__group").cogroup(sent.groupBy("__of")).applyInArrow(
        lambda left, right: pooled_means(left, right, made_arrow, "f4" if narrow else "f8"), made)


def fit_scaler(train: DataFrame, vector: str) -> DataFrame:
    """One row: mean and population deviation of each dimension (1 where it does not vary)."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(as_vector(F.col(vector)))
    stats = train.agg(summary.alias("s")).select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"),
        F.col("s.count").cast("double").alias("n"))
    # The summary divides by n - 1.
    spread = F.transform("variance", lambda v: F.sqrt(v * (F.col("n") - 1) / F.col("n")))
    safe = F.transform(spread, lambda d: F.when(d > 0, d).otherwise(F.lit(1.0)))
    return stats.select("mean", safe.alias("deviation"))


def apply_scaler(df: DataFrame, scaler: DataFrame, vector: str, out: str) -> DataFrame:
    """``df`` plus the scaled array. The scaler is one row, read as a scalar subquery."""
    row = scaler.select(F.struct("mean", "deviation").alias("s")).scalar()
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.col("__s.mean"), lambda x, m: x - m)
    scaled = F.zip_with(centred, F.col("__s.deviation"), lambda x, d: x / d)
    return df.withColumn("__s", row).withColumn(out, scaled).drop("__s")


HASHES = {
    # The digits of md5 can be made by any engine, those of xxhash64 in a tenth of the time.
    "md5": "substring(md5(t), 1, {0})",
    "xxhash64": "substring(lpad(lower(hex(xxhash64(t))), 16, '0'), 1, {0})",
}


def bucket_counts(df: DataFrame, terms: str, keep: Sequence[str], digits: int, hashing: str = "md5") -> DataFrame:
    """``keep`` columns plus ``counts``: a sparse vector, how often the terms of each bucket occur.

    ``terms``: SQL for an array of strings. A term belongs to the bucket named by the first ``digits`` hex digits of
    its hash, so there are ``16 ** digits`` dimensions, however many terms there are. Short rows come
    out, so store them: all that follows then reads and cuts every text once.
    """
    buckets = [f"{i:0{digits}x}" for i in range(16 ** digits)]
    hashed = df.withColumn("__buckets", F.expr(f"transform({terms}, t -> {HASHES[hashing].format(digits)})"))
    counter = CountVectorizerModel.from_vocabulary(buckets, inputCol="__buckets", outputCol="counts")
    return counter.transform(hashed).select(*keep, "counts")


def hash_tokens(df: DataFrame, keep: Sequence[str], text: str = "code", digits: int = 2,
                hashing: str = "md5") -> DataFrame:
    """``bucket_counts`` of all tokens of a text: vectors by hash have one size for any length."""
    return bucket_counts(df.withColumn("tokens", text_tokens(F.col(text))), "tokens", keep, digits, hashing)


def text_embedder(counts: str = "counts") -> Pipeline:
    """Estimator of fixed-size text vectors from ``hash_tokens``: shares of tokens by hash, weighted by rarity.

    Counts become shares of the text's tokens, so before weighting the vector is the
    mean of the one-hot vectors of the tokens' buckets.
    """
    return Pipeline(stages=[Normalizer(p=1.0, inputCol=counts, outputCol="shares"),
                            IDF(inputCol="shares", outputCol="weighted")])


def embed_text(counted: DataFrame, fitted, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus ``embedding``, from a frame of ``hash_tokens``."""
    return fitted.transform(counted).select(*keep, vector_to_array("weighted").alias("embedding"))


def sparse_entries(vector: str) -> Column:
    """The stored entries of a sparse vector as an array of ``struct(dim, value)``: as many as it has, whatever its
    size."""
    inner = F.unwrap_udt(F.col(vector))
    return F.arrays_zip(inner["indices"].alias("dim"), inner["values"].alias("value"))


def assemble(df: DataFrame, embedding: str = "embedding",
             features: Sequence[str] = FEATURES) -> DataFrame:
    """``df`` plus the array ``features``: the embedding, then the named columns, as floats."""
    return df.withColumn("features", F.concat(F.col(embedding).cast("array<float>"),
                                              feature_array(features)))

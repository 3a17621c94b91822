"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams are counted, one over target
documents (labelled as good) and one over all raw documents. The log of their ratio is a
document's importance weight. Gumbel noise is added, and the ``k`` largest sums are
a sample without replacement that follows the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribeprint.llm.scratch import importable, map_rows, quoted, without, written
from scribeprint.llm.words import MARKS, mix, read_words, sequence_hashes, whole_windows

#: Hashed n-grams fall in so many buckets: the size of both models.
BUCKETS = 1 << 14
#: At most so many labelled target documents fit the target model, those with the smallest hash of
#: their id. Raw counts are over all documents.
TARGET_DOCS = 20_000
#: Bins of one histogram round, and the most keys brought to the driver to find the cut.
BINS = 4096
CUT_ROWS = 10_000
ADDED = ("n_words", "log_ratio", "sample_key", "kept")


def ngram_buckets(words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Row (counted from the first of ``words``) and bucket of all single words and word pairs."""
    pairs = whole_windows(words, 2)
    rows = words.row
    bucket = np.concatenate([mix(words.hashes), sequence_hashes(words.hashes, 2, 7)[pairs]])
    return np.concatenate([rows, rows[pairs]]), (bucket % np.uint64(buckets)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], targets, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row a bucket and task: n-grams of target and of all documents."""
    ids = pa.array(targets.value, pa.int64())
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for batch in batches:
        good = pc.is_in(batch.column(0), value_set=ids, skip_nulls=True).to_numpy(zero_copy_only=False)
        for words in read_words(batch.column(1), MARKS, fold=True):
            rows, bucket = ngram_buckets(words, buckets)
            raw += np.bincount(bucket, minlength=buckets)
            target += np.bincount(bucket[good[words.low:words.high][rows]], minlength=buckets)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(target[used]), pa.array(raw[used])],
                                     names=["bucket", "target", "raw"])


def log_ratios(df: DataFrame, target_ids: DataFrame, doc_id: str, text: str,
               buckets: int = BUCKETS, target_docs: int = TARGET_DOCS) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, both with one added to every count."""
    importable(df.sparkSession)
    label_id = target_ids.columns[0]
    ids = (target_ids.select(F.col(label_id).cast("long").alias("id")).dropna().distinct()
           .orderBy(F.xxhash64("id"), "id").limit(target_docs))
    targets = df.sparkSession.sparkContext.broadcast([r["id"] for r in ids.collect()])
    counted = (df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
               .mapInArrow(lambda b: _counts(b, targets, buckets), "bucket long, target long, raw long")
               .groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")))
    target, raw = np.ones(buckets), np.ones(buckets)
    for r in counted.collect():  # at most ``buckets`` rows
        target[r["bucket"]] += r["target"]
        raw[r["bucket"]] += r["raw"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _scores(batches: Iterator[pa.RecordBatch], model, text_at: int, schema) -> Iterator[pa.RecordBatch]:
    ratios = model.value
    for batch in batches:
        n, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        for words in read_words(batch.column(text_at), MARKS, fold=True):
            rows, bucket = ngram_buckets(words, len(ratios))
            n[words.low:words.high] = words.counts
            score[words.low:words.high] = np.bincount(rows, ratios[bucket], words.high - words.low)
        keep = [c for k, c in enumerate(batch.columns) if k != text_at]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(n), pa.array(score)], schema=schema)


def cut_of(keys: DataFrame, k: int) -> float | None:
    """The ``k``-th largest of one column of doubles, by histograms that narrow down to it."""
    name = keys.columns[0]
    key = F.col(name)
    span = keys.agg(F.min(key), F.max(key)).first()
    low, high = span
    while low is not None and low < high:
        part = keys.filter((key >= low) & (key <= high))
        bin_ = F.least(F.floor((key - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = sorted(part.groupBy(bin_.alias("bin")).agg(F.count(key).alias("n"), F.min(key).alias("low"),
                                                          F.max(key).alias("high")).collect(),
                      key=lambda r: -r["bin"])
        for r in bins:
            if k <= r["n"]:
                break
            k -= r["n"]
        low, high = r["low"], r["high"]
        if r["n"] <= CUT_ROWS and low < high:
            inside = keys.filter((key >= low) & (key <= high)).collect()
            return sorted((x[0] for x in inside), reverse=True)[k - 1]
    return low


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float, doc_id: str = "doc_id",
             text: str = "text", seed: int = 1, buckets: int = BUCKETS,
             target_docs: int = TARGET_DOCS) -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``log_ratio``, ``sample_key`` and ``kept``.

    ``target_ids``: one column, ids of target documents. ``kept`` marks the
    ``round(fraction * rows)`` largest keys, a key being the log ratio plus Gumbel noise
    that follows from seed and id, so that reruns agree. Rows with equal keys are kept
    or left together, so repeated rows can make the sample larger by their number.

    Null or empty text has log ratio 0. A null id is no target, and its noise
    is that of a null. Without target documents both models differ by smoothing only. An
    empty table gives an empty result. Columns with the names of the result are replaced.
    """
    model = log_ratios(docs, target_ids, doc_id, text, buckets, target_docs)
    base = without(docs, *(c for c in ADDED if c not in (doc_id, text)))
    spark, at = docs.sparkSession, base.columns.index(text)
    shared = spark.sparkContext.broadcast(model)
    fields = [f for k, f in enumerate(base.schema.fields) if k != at]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()),
                           T.StructField("log_ratio", T.DoubleType())])
    scored = map_rows(base, lambda b, arrow: _scores(b, shared, at, arrow), schema)
    # A uniform number in (0, 1) from 52 bits of a hash.
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))),
                    F.lit(1 << 52))
    uniform = (hashed + 0.5) / float(1 << 52)
    keyed = written(scored.withColumn("sample_key", F.col("log_ratio") - F.log(-F.log(uniform))), "resampling")
    k = round(fraction * keyed.count())
    cut = cut_of(keyed.select("sample_key"), k) if k else None
    kept = F.lit(False) if cut is None else F.col("sample_key") >= F.lit(cut)
    return keyed.select(*quoted(keyed), kept.alias("kept"))


def good_share(labels: DataFrame, label: str = "quality") -> float:
    """Share of good documents among the labelled."""
    r = labels.agg(F.count(label).alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("good")).first()
    return r["good"] / r["n"] if r["n"] else 1.0

"""Importance resampling towards a target distribution: array-scored weights, ranks by a distributed radix sort.

Words of whole texts make features (runs of ``LOW`` to ``HIGH`` words), features fall into buckets by CRC-32. The
counts of all raw and of all target texts give one gain a bucket, an array; the weight of a document is the sum
of the gains at its buckets, one look-up in the array for all of them. Gumbel noise that follows from the id is
added, and the documents with the highest scores are drawn.

Ranks come from a least-significant-digit radix sort of the composite key (score, then id) over the cluster. Every
row has a place; a chunk is a stretch of places. A pass counts rows by chunk and digit, running sums of those
counts over digits and then over chunks give the place where each chunk's rows of a digit begin, and a row goes
there behind the earlier rows of its chunk and digit, so that the pass is stable. After the last digit, places
are ranks. A pass moves the rows once, by chunk and digit: no task ever gets more than a chunk of one digit, even
if all keys are equal, and digits that are the same in all rows are skipped.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribeprint.llm.scratch import map_rows, written
from scribeprint.llm.words import MARKS, Words, read_words, sequence_hashes, whole_windows

LOW, HIGH = 1, 1
#: Buckets of features: the gains and counts that are held at once, in the driver too.
BUCKETS = 10_000
SEED = 2024
MIN_WORDS, PERCENT = 20, 10
#: Bits of a digit of the radix sort, and the places of a chunk.
DIGIT_BITS = 12
CHUNK = 1 << 18
_TOP = -(1 << 63)


def _names(words: Words, first: np.ndarray, n: int) -> Iterator[bytes]:
    """The bytes of runs of ``n`` words, folded and joined by one space."""
    for k in first.tolist():
        yield b" ".join(words.data[words.start[j]:words.end[j]].tobytes() for j in range(k, k + n)).lower()


def _feature_buckets(words: Words, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, in order of their rows, and where those of each row begin."""
    rows, found = [], []
    for n in range(low, high + 1):
        first = whole_windows(words, n)
        hashes = sequence_hashes(words.hashes, n)[first] if n > 1 else words.hashes
        _, sample, each = np.unique(hashes, return_index=True, return_inverse=True)
        crc = np.fromiter((zlib.crc32(name) % buckets for name in _names(words, first[sample], n)), np.int64,
                          len(sample))
        found.append(crc[each])
        rows.append(words.row[first])
    rows, found = np.concatenate(rows), np.concatenate(found)
    if high > low:
        order = np.argsort(rows, kind="stable")
        rows, found = rows[order], found[order]
    return found, np.searchsorted(rows, np.arange(words.high - words.low + 1))


def _read(batches: Iterator[pa.RecordBatch], schema: pa.Schema, low: int, high: int, buckets: int):
    kind = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")
    for batch in batches:
        n_words, n_features, stored = [], [], []
        for words in read_words(batch.column(0), MARKS, fold=True):
            found, first = _feature_buckets(words, low, high, buckets)
            n_words += words.counts.tolist()
            n_features += np.diff(first).tolist()
            found = found.astype(kind)
            stored += [found[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        columns = [pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(stored, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], schema=schema)


def features(docs: DataFrame, text: str = "text", low: int = LOW, high: int = HIGH,
             buckets: int = BUCKETS, keep: Column | None = None) -> DataFrame:
    """``keep`` (if any), ``n_words``, ``n_features`` and ``buckets`` (packed numbers). Null text has no words."""
    plain = docs.select(F.col(text), *([] if keep is None else [keep]))
    schema = T.StructType([*plain.schema.fields[1:], T.StructField("n_words", T.LongType()),
                           T.StructField("n_features", T.LongType()), T.StructField("buckets", T.BinaryType())])
    return map_rows(plain, lambda b, arrow: _read(b, arrow, low, high, buckets), schema)


def _numbers(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All packed numbers of a batch, and where those of each row begin."""
    width = 2 if buckets <= 1 << 16 else 4
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data.view(f"<u{width}"), (offsets.astype(np.int64) - int(offsets[0])) // width


def bucket_counts(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket. Tasks add up first, so at most ``buckets`` rows a task are shuffled."""
    def add(batches, arrow):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0), buckets)[0], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], schema=arrow)

    summed = map_rows(featured.select("buckets"), add, T.StructType.fromDDL("bucket long, n long"))
    out = np.zeros(buckets, np.int64)
    for row in summed.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to raw frequency of each bucket, smoothed by one, rounded down."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n))))
                     for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def gumbel_noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of the Gumbel variate that an id has under a seed."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(batches: Iterator[pa.RecordBatch], schema: pa.Schema, gains: np.ndarray, seed: int):
    """Input: packed buckets and id, then what is passed on."""
    for batch in batches:
        numbers, first = _numbers(batch.column(0), len(gains))
        sums = np.concatenate([[0], np.cumsum(gains[numbers])])
        weight = sums[first[1:]] - sums[first[:-1]]
        noise = np.array([gumbel_noise(d, seed) for d in batch.column(1).to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(weight), pa.array(weight + noise)],
                                         schema=schema)


def _bits(low: int, high: int) -> int:
    """Bits below the highest one in which the values of a range differ."""
    return ((low ^ high) & ((1 << 64) - 1)).bit_length()


def _digit(key: str, shift: int, bits: int, descending: bool) -> Column:
    """A digit of a long as if it were counted from the least long, so that negative values come first."""
    value = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(_TOP)), shift).bitwiseAND(F.lit((1 << bits) - 1))
    return F.lit((1 << bits) - 1) - value if descending else value


def radix_pass(rows: DataFrame, digit: Column, place: str, chunk: int) -> DataFrame:
    """``rows`` with new values of ``place``: a stable counting sort by ``digit``."""
    marked = rows.withColumn("chunk_", F.expr(f"{place} div {chunk}")).withColumn("digit_", digit)
    counts = written(marked.groupBy("chunk_", "digit_").agg(F.count(F.lit(1)).alias("n_")), "radix-counts")
    # Prefix offsets: all rows of smaller digits, then those of the same digit in earlier chunks.
    by_digit = counts.groupBy("digit_").agg(F.sum("n_").alias("all_"))
    smaller = by_digit.select("digit_", (F.sum("all_").over(Window.orderBy("digit_")) - F.col("all_")).alias("base_"))
    earlier = Window.partitionBy("digit_").orderBy("chunk_")
    begins = (counts.join(smaller, "digit_")
              .select("chunk_", "digit_", (F.col("base_") + F.sum("n_").over(earlier) - F.col("n_")).alias("begin_")))
    within = F.row_number().over(Window.partitionBy("chunk_", "digit_").orderBy(place)) - 1
    return (marked.withColumn("within_", within).join(begins, ["chunk_", "digit_"])
            .withColumn(place, F.col("begin_") + F.col("within_")).select(*rows.columns))


def radix_sort(rows: DataFrame, *keys: tuple[str, bool], place: str = "place", bits: int = DIGIT_BITS,
               chunk: int = CHUNK) -> DataFrame:
    """``rows`` with ``place`` replaced by their place, from 0, in the order of ``keys``: (long column, descending).

    The first key decides first; equal rows keep the order of their old ``place``, which has to be a long of its
    own in each row, and the same whenever ``rows`` is read, as in a stored table. Every pass is written, so a lost executor costs one pass at most.
    """
    spans = rows.agg(*[f(k).alias(f"{n}_{k}") for k, _ in keys for n, f in (("low", F.min), ("high", F.max))]).first()
    if spans[0] is None:
        return rows
    for key, descending in reversed(keys):
        span = _bits(spans[f"low_{key}"], spans[f"high_{key}"])
        for shift in range(0, span, bits):
            width = min(bits, span - shift)
            rows = written(radix_pass(rows, _digit(key, shift, width, descending), place, chunk), "radix-pass")
    if sum(_bits(spans[f"low_{k}"], spans[f"high_{k}"]) for k, _ in keys) == 0:  # all keys equal
        rows = written(radix_pass(rows, F.lit(0).cast("long"), place, chunk), "radix-pass")
    return rows


def scored(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
           low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document."""
    raw = written(features(docs, text, low, high, buckets, F.col(doc_id).cast("long").alias("doc_id")), "features")
    wanted = features(target, target_text, low, high, buckets)
    gains = bucket_gains(bucket_counts(raw, buckets), bucket_counts(wanted, buckets))
    plain = raw.select("buckets", "doc_id", "n_words", "n_features")
    schema = T.StructType([*plain.schema.fields[1:], T.StructField("weight", T.LongType()),
                           T.StructField("score", T.LongType())])
    return map_rows(plain, lambda b, arrow: _score(b, arrow, gains, seed), schema)


def resample_to_target(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
                       chunk: int = CHUNK, digit_bits: int = DIGIT_BITS, **options) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null where not drawn.

    Of the documents with at least ``min_words`` words, ``percent`` percent (rounded down) are drawn: those with the
    highest scores, of equal ones those with smaller ids. ``options``: those of ``scored``.

    Null and empty texts have no features and weight 0. A null id has the noise of the word ``null`` and stands
    behind all others of its score. Repeated rows are drawn each by itself and get ranks of their own. An
    empty table gives an empty result; without target texts all is scored against even frequencies. Only
    the id and the text are read of a table, so other columns may have any name. Texts are scored whole.
    """
    table = written(scored(docs, target, **options).withColumn("place", F.monotonically_increasing_id()), "scored")
    enough = F.col("n_words") >= min_words
    n_drawn = table.filter(enough).count() * percent // 100
    key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    ranked = radix_sort(table.filter(enough).withColumn("key", key), ("score", True), ("key", False),
                        chunk=chunk, bits=digit_bits)
    rank = F.when(F.col("place") < n_drawn, F.col("place") + 1)
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*names, rank.alias("rank")).unionByName(
        table.filter(~enough).select(*names, F.lit(None).cast("long").alias("rank")))

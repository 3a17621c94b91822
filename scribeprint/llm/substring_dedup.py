"""Substring dedup by seed and extend.

A repeat is a run of at least ``LENGTH`` words that also starts elsewhere. Anchors are picked by winnowing: of
every ``LENGTH`` words, the run of ``ANCHOR`` words with the smallest hash (the last one of equals) is the
anchor. It depends on those words only, so equal windows have equal anchors at equal places, and
the windows of one anchor are neighbours: a span around it.

1. Seed: documents meet on anchors; an anchor that occurs once has no repeated window.
2. Extend: occurrences of an anchor whose whole spans are equal repeat in all of their windows. Of
   equal spans one stands for all, so a passage in very many documents is one row from here on. Where an anchor
   has spans that differ, matches end inside of them: the windows of these few spans are compared one by one.
3. Maximal repeats are the unions of repeated windows. Words inside are removed.

Every step groups by hashes with partial sums; pairs of documents are never made, so hot
passages cost no more than others. Anchor and span are both 64-bit hashes and count as equal only
together; windows that are compared one by one have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribeprint.llm.scratch import as_text, importable, map_rows, quoted, without, written
from scribeprint.llm.words import BLANKS, mix, read_words, running_powers, runs, sequence_hashes

LENGTH = 35
ANCHOR = 8
#: Windows of one text handled at a time, far below what an anchor's place is kept in.
STRETCH = 1 << 20
_PLACE_BITS = 24
ADDED = ("n_words", "n_removed", "kept_text")

OCCURRENCES = "anchor long, span long, doc long, text_hash long, first int, last int"


def anchors(hashes: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """Place of the anchor of each window of ``length`` words, in one run of at most ``STRETCH`` windows."""
    grams = sequence_hashes(hashes, anchor, 1)
    places = np.uint64((1 << _PLACE_BITS) - 1) - np.arange(len(grams), dtype=np.uint64)
    least = (grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | places
    width, reach = length - anchor + 1, 1
    while reach < width:  # least of ``reach`` neighbours, doubled; the last step overlaps
        step = min(reach, width - reach)
        least = np.minimum(least[:len(least) - step], least[step:])
        reach += step
    low = np.uint64((1 << _PLACE_BITS) - 1)
    return (low - (least & low)).astype(np.int64)


def _row_spans(hashes: np.ndarray, length: int, anchor: int):
    """(anchor hash, span hash, first and last window start) of each anchor of one text."""
    out = []
    for low in range(0, len(hashes) - length + 1, STRETCH):
        own = hashes[low:low + STRETCH + length - 1]
        place = anchors(own, length, anchor)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        out.append(_hash_spans(own, place[first], first, last, length, anchor, low))
    return out


_STEP = np.uint64(0xD6E8FEB86659FD93 | 1)


def _hash_spans(hashes, place, first, last, length, anchor, low):
    grams = sequence_hashes(hashes, anchor, 1)[place]
    up, down = _powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    body = (sums[last + length] - sums[first]) * down[first]
    shape = (place - first).astype(np.uint64) * np.uint64(4096) + (last - first).astype(np.uint64)
    return grams, mix(body + mix(shape)), first + low, last + low


_POWERS: list = []


def _powers(n: int):
    if not _POWERS or len(_POWERS[0]) < n:
        size, base = max(n, 1 << 16), int(_STEP)
        _POWERS[:] = [running_powers(base, size), running_powers(pow(base, -1, 1 << 64), size)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _occurrences(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Input: doc, text hash, text."""
    for batch in batches:
        doc, text_hash = batch.column(0), batch.column(1)
        for words in read_words(batch.column(2), BLANKS, fold=False):
            columns, rows = [], []
            for r in np.flatnonzero(words.counts >= length):
                for part in _row_spans(words.hashes[words.first[r]:words.first[r + 1]], length, anchor):
                    columns.append(part)
                    rows.append(np.full(len(part[0]), words.low + r))
            if not rows:
                continue
            gram, span, first, last = (np.concatenate(c) for c in zip(*columns))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(span.view(np.int64)), doc.take(at), text_hash.take(at),
                 pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                names=["anchor", "span", "doc", "text_hash", "first", "last"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Input: doc, text hash, ranges of window starts, text. One row for each window in the ranges."""
    for batch in batches:
        doc, text_hash, ranges = batch.column(0), batch.column(1), batch.column(2)
        for words in read_words(batch.column(3), BLANKS, fold=False):
            out = []
            for r in range(words.low, words.high):
                own = words.hashes[words.first[r - words.low]:words.first[r - words.low + 1]]
                spans = np.array([(s["first"], s["last"]) for s in ranges[r].as_py()], np.int64)
                if not len(spans):
                    continue
                for a, b in joined(spans + [0, 1]):
                    for low in range(a, b, STRETCH):
                        part = own[low:min(b, low + STRETCH) + length - 1]
                        one, two = sequence_hashes(part, length, 2), sequence_hashes(part, length, 3)
                        out.append((one.view(np.int64), two.view(np.int64), np.full(len(one), r),
                                    np.arange(low, low + len(one), dtype=np.int32)))
            if out:
                one, two, row, place = (np.concatenate(c) for c in zip(*out))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), doc.take(at), text_hash.take(at), pa.array(place)],
                    names=["one", "two", "doc", "text_hash", "place"])


def joined(spans: np.ndarray) -> list[tuple[int, int]]:
    """Unions of [first, last) ranges that overlap or touch."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    begins = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return list(zip(spans[begins, 0].tolist(), reach[np.append(begins[1:], len(spans)) - 1].tolist()))


def _removed(batches: Iterator[pa.RecordBatch], length: int, text_at: int, ranges_at: int, keep: list[int],
             schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        ranges = batch.column(ranges_at)
        for words in read_words(batch.column(text_at), BLANKS, fold=False):
            for r in range(words.low, words.high):
                low, high = words.first[r - words.low], words.first[r - words.low + 1]
                keep_word = np.ones(high - low, bool)
                own = ranges[r].as_py()
                if own:
                    for a, b in joined(np.array([(s["first"], s["last"] + length) for s in own], np.int64)):
                        keep_word[a:b] = False
                n_words.append(int(high - low))
                n_removed.append(int((~keep_word).sum()))
                kept.append(_joined_words(words, low, high, keep_word))
        columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns], schema=schema)


def _joined_words(words, low, high, keep_word) -> str:
    """The kept words with one space between them."""
    start, end = words.start[low:high][keep_word], words.end[low:high][keep_word]
    if not len(start):
        return ""
    size = end - start
    out = np.full(int(size.sum()) + len(size) - 1, 32, np.uint8)
    begins = np.cumsum(size + 1) - size - 1
    out[runs(begins, size)] = words.data[runs(start, size)]
    return out.tobytes().decode()


def repeated_spans(keyed: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc, text_hash, first, last``: ranges of starts of repeated windows. ``keyed``: doc, text_hash, text."""
    importable(keyed.sparkSession)
    found = keyed.mapInArrow(lambda b: _occurrences(b, length, anchor), OCCURRENCES)
    found = written(found, "anchors")
    # Seed. Counts are added up before and after the shuffle, so hot anchors are short rows.
    # They are written: of a join of two tables Spark splits a hot key, of one with sums it does not.
    often = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"),
                    "repeated-anchors")
    seeded = written(found.join(often, "anchor"), "seeds")
    # Extend: one row stands for all equal spans of an anchor.
    one = F.min(F.struct("doc", "text_hash", "first", "last")).alias("one")
    spans = written(seeded.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("n"), one), "spans")
    equal = seeded.join(spans.filter("n > 1").select("anchor", "span"), ["anchor", "span"]).select(
        "doc", "text_hash", "first", "last")
    mixed = written(spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_spans")).filter("n_spans > 1")
                    .select("anchor"), "mixed-anchors")
    differing = spans.join(mixed, "anchor").select("n", "one.*")
    wanted = differing.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    texts = _with_text(wanted, keyed).select("doc", "text_hash", "ranges", "text")
    windows = written(texts.mapInArrow(
        lambda b: _windows(b, length), "one long, two long, doc long, text_hash long, place int"), "windows")
    twice = written(windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                    .select("one", "two"), "repeated-windows")
    partly = windows.join(twice, ["one", "two"]).select(
        "doc", "text_hash", F.col("place").alias("first"), F.col("place").alias("last"))
    return equal.unionByName(partly)


def _with_text(ranges: DataFrame, keyed: DataFrame) -> DataFrame:
    """Range lists with the text. Rows of equal id and text all come, which counts their windows as often:
    rightly so, as such windows do start elsewhere."""
    r = ranges.select(F.col("doc").alias("d_"), F.col("text_hash").alias("h_"), "ranges")
    return keyed.join(r, keyed["doc"].eqNullSafe(r["d_"]) & (keyed["text_hash"] == r["h_"]))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   anchor: int = ANCHOR) -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``n_removed`` and ``kept_text``.

    Removed are all words inside of a run of ``length`` words that also starts elsewhere, in
    the same document or another; what is left is judged on the input, not again.

    Null, empty and short texts have no such run. Rows of equal id and text count as two places, so both lose
    their long runs. Ids may be null or equal, since a row is known by id and text together. An
    empty table stays empty. Texts of any length are read whole. Columns with the names of the
    result are replaced, others stay.
    """
    base = without(docs, *(c for c in ADDED if c not in (doc_id, text)))
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(as_text(text)).alias("text_hash"),
                        as_text(text).alias("text"))
    spans = repeated_spans(keyed, length, anchor)
    ranges = spans.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("ranges_"))
    ranges = ranges.select(F.col("doc").alias("doc_"), F.col("text_hash").alias("text_hash_"), "ranges_")
    hashed = F.xxhash64(as_text(text))
    all_ = base.join(ranges, base[doc_id].cast("long").eqNullSafe(ranges["doc_"])
                     & (hashed == ranges["text_hash_"]), "left")
    columns = base.columns
    keep = [k for k, c in enumerate(columns) if c != text]
    schema = T.StructType([*(base.schema.fields[k] for k in keep), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    text_at, ranges_at = columns.index(text), len(columns)
    picked = all_.select(*(base[c] for c in quoted(base)), ranges["ranges_"])
    return map_rows(picked, lambda b, arrow: _removed(b, length, text_at, ranges_at, keep, arrow), schema)

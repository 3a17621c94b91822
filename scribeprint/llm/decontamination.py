"""Benchmark decontamination: one automaton over all windows of the benchmark, one scan per text.

Benchmark items are normalised (A-Z lower-cased, everything but letters, digits
and non-ASCII is a gap) and cut into windows of ``WINDOW`` words; an item with
fewer words is one window. All windows form one Aho-Corasick automaton. A text is
normalised with the same rule and scanned once; a match is turned into word numbers
and into offsets of the original text.

The benchmark is a query set. It is read in blocks of bounded size: one
automaton holds at most ``BLOCK_BYTES`` of item text, and a larger benchmark is
scanned for block after block, with nothing dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribeprint.llm.scratch import as_text, free_name, map_rows, quoted, without, written

WINDOW = 10
BLOCK_BYTES = 8 << 20

#: Every byte that is no part of a word becomes a space, A-Z becomes a-z.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else
                b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAPS = re.compile(rb" {2,}")


def normalise(text: str | None) -> str:
    """Words with one space before and after each; empty without words."""
    plain = _GAPS.sub(b" ", (text or "").encode().translate(_NORMAL)).strip(b" ")
    return f" {plain.decode()} " if plain else ""


def windows(text: str | None, size: int = WINDOW) -> list[str]:
    """Windows of an item in the form in which they stand in normalised texts."""
    words = normalise(text).split(" ")[1:-1]
    if not words:
        return []
    return [f" {' '.join(words[k:k + size])} " for k in range(max(1, len(words) - size + 1))]


def automaton(items: list[tuple[object, str | None]], size: int = WINDOW):
    """Aho-Corasick automaton; its values are (number of words, items that have the window)."""
    owners: dict[str, set] = {}
    for number, (_, text) in enumerate(items):
        for window in windows(text, size):
            owners.setdefault(window, set()).add(number)
    machine = ahocorasick.Automaton()
    for window, numbers in owners.items():
        machine.add_word(window, (len(window), tuple(sorted(numbers))))
    if owners:
        machine.make_automaton()
    return machine


_BUILT: dict[tuple, tuple] = {}


def _machine(block: Broadcast, size: int):
    """Built once in a worker, from the items that were broadcast."""
    key = (id(block.value), size)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = (block.value, automaton(block.value, size))  # holds the list, so its id stays taken
    return _BUILT[key][1]


def matches(text: str, machine) -> tuple[np.ndarray, set]:
    """Places of windows in a normalised text, [first, last) by word, and the items they belong to."""
    ends, lengths, found = [], [], set()
    if text and len(machine):
        for end, (length, numbers) in machine.iter(text):
            ends.append(end)
            lengths.append(length)
            found.update(numbers)
    if not ends:
        return np.empty((0, 2), np.int64), found
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
    last = np.searchsorted(spaces, np.array(ends))
    first = np.searchsorted(spaces, np.array(ends) - np.array(lengths) + 1)
    return np.stack([first, last], axis=1), found


def covered(places: np.ndarray) -> np.ndarray:
    """Union of [first, last) ranges, sorted and not touching."""
    if not len(places):
        return places
    places = places[np.lexsort((places[:, 1], places[:, 0]))]
    reach = np.maximum.accumulate(places[:, 1])
    new = np.concatenate([[True], places[1:, 0] > reach[:-1]])
    begins = np.flatnonzero(new)
    return np.stack([places[begins, 0], reach[np.append(begins[1:], len(places)) - 1]], axis=1)


_WORD = re.compile(rb"[^ ]+")


def original_offsets(text: str, ranges: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words as ranges of characters in the text as it was given."""
    if not len(ranges):
        return []
    data = text.encode()
    spans = [m.span() for m in _WORD.finditer(data.translate(_NORMAL))]
    # Bytes that start a character, summed: byte offset to code point offset.
    lead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    at = lambda byte: int(lead[byte - 1]) if byte else 0
    return [(at(spans[a][0]), at(spans[b - 1][1])) for a, b in ranges]


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("hit_chars", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
ADDED = tuple(RESULT.names)


def _scan(batches: Iterator[pa.RecordBatch], block, size: int, text_at: int, had_at: int | None,
          schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    machine = _machine(block, size)
    names = [None if x[0] is None else str(x[0]) for x in block.value]
    for batch in batches:
        columns = {n: [] for n in ADDED}
        had = ([batch.column(had_at + k).to_pylist() for k in range(len(ADDED))]
               if had_at is not None else None)
        for row, text in enumerate(batch.column(text_at)):
            text = text.as_py() or ""
            plain = normalise(text)
            places, found = matches(plain, machine)
            items = {names[x] for x in found if names[x] is not None}
            if had:
                places = np.concatenate([places, np.array(had[1][row], np.int64).reshape(-1, 2)])
                items |= set(had[3][row])
            ranges = covered(places)
            columns["n_words"].append(max(plain.count(" ") - 1, 0))
            columns["hit_words"].append(ranges.tolist())
            columns["hit_chars"].append([list(x) for x in original_offsets(text, ranges)])
            columns["items"].append(sorted(items))
        keep = batch.num_columns if had_at is None else had_at
        arrays = [batch.column(k) for k in range(keep)]
        arrays += [pa.array(columns[n], schema.field(keep + k).type) for k, n in enumerate(ADDED)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES):
    """The items, as lists of at most about ``block_bytes`` of text; one list is on the driver at a time.

    Items with equal words are one entry under each of their ids. The number of
    blocks follows the size of the benchmark, which is counted first.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), as_text(text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-int(size) // block_bytes))
    block = F.pmod(F.xxhash64("text", "item"), F.lit(count))
    for k in range(count):
        yield [(r["item"], r["text"]) for r in items.filter(block == k).collect()]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", size: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words``, ``hit_chars`` and ``items``.

    ``hit_words`` are the ranges [first, last) of words that lie inside an
    occurrence of a window, ``hit_chars`` the same as code point offsets of the
    original text, ``items`` the ids (as strings, sorted) of the items with a window
    there. Rows with equal ids stay apart, as every row is scanned by itself.

    Null or empty text: no words and no hits. An item without words has no
    window. An item without id marks words but is not listed. An
    empty benchmark hits nothing, and an empty table stays empty. Columns of
    ``docs`` with the names of the result are replaced; ``text`` and all others stay.
    """
    if text in ADDED:
        raise ValueError(f"rename the text column {text!r}; the result has a column of that name")
    out = without(docs, *ADDED)
    spark = docs.sparkSession
    n_before = len(out.columns)
    for number, items in enumerate(blocks(benchmark, item_id, item_text, block_bytes)):
        if number:
            out = written(out, "decontamination")
        out = _pass(out, spark.sparkContext.broadcast(items), size, out.columns.index(text),
                    n_before, bool(number))
    return out


def _pass(df: DataFrame, block, size: int, text_at: int, n_before: int, again: bool) -> DataFrame:
    schema = T.StructType([*df.schema.fields[:n_before], *RESULT.fields])
    had_at = n_before if again else None
    return map_rows(df, lambda b, arrow: _scan(b, block, size, text_at, had_at, arrow), schema)


def n_hit_words(ranges: str = "hit_words"):
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + (r[1] - r[0]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with their own columns, whatever their names.

    Null and empty texts stay. Repeated rows go or stay together; with an empty benchmark all stay; an empty table
    stays empty.
    """
    clashing = [c for c in docs.columns if c.lower() in ADDED]
    hidden = {c: free_name(docs, f"{c}_own") for c in clashing}
    options["text"] = hidden.get(options.get("text", "text"), options.get("text", "text"))
    found = find_benchmark(docs.withColumnsRenamed(hidden), benchmark, **options)
    clean = found.filter(F.size("hit_words") == 0).drop(*ADDED)
    return clean.withColumnsRenamed({new: old for old, new in hidden.items()}).select(*quoted(docs))


def items_digest(column: str = "items"):
    """Lowercase hexadecimal SHA-256 of the ids, joined by commas."""
    return F.sha2(F.array_join(column, ","), 256)

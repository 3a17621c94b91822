"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

A byte-pair encoding of a string ends in exactly one token ``t`` whose pair with the last
token of the rest is one that the merges would leave apart. So the last token
of every prefix follows from the last tokens of the shorter ones, and its count
is one more than that of the rest. Texts are first cut into words by the tokenizer's pattern;
words are encoded apart, and the counts of a word's prefixes are kept in a bounded
cache. With the count at every prefix stored, questions of truncation and budget are
answered by looking, without encoding again.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scribeprint.llm.scratch import map_rows, without
from scribeprint.llm.words import BYTE_VALUES, POWERS, text_buffers

#: Words and token pairs whose results a worker keeps; it starts anew when one is full.
CACHE_WORDS = 300_000
CACHE_PAIRS = 300_000
#: Words of the usual pattern whose prefixes are not words of it.
CONTRACTIONS = ("'re", "'ve", "'ll")
#: Bytes of text handled at a time, and the longest word that is encoded together with others.
PIECE = 2 << 20
LONG_WORD = 64
#: One space between a letter or digit and a letter: it begins a word, whatever else the text holds.
SAFE_CUT = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z])")
_SPREAD = 0x9E3779B97F4A7C15
ADDED = ("n_bytes", "n_tokens", "prefix_counts")


class PrefixCounter:
    """Prefix counts under one byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.special = [t["content"] for t in data["added_tokens"]]
        to_byte = _byte_of_letter()
        self.tokens = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items()
                       if all(c in to_byte for c in t)}
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {tuple(bytes(to_byte[c] for c in side) for side in m): n for n, m in enumerate(merges)}
        #: token -> (rank of the merge that makes it, left part, right part)
        self.made = {a + b: (n, a, b) for (a, b), n in self.ranks.items()}
        self.chains: tuple[dict, dict] = ({}, {})
        self.longest = max(map(len, self.tokens))
        self.cut = regex.compile(pattern).findall
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
                                   or r"(?!)").split
        self.blanks = regex.compile(r"\s{2,}(?=\S)").finditer
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[str, bytes] = {}

    def edges(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Parts that stand at one edge while the token is built, and the rank of the merge that ends each."""
        known = self.chains[side].get(token)
        if known is None:
            known, ends = [(token, 1 << 30)], self.made.get(token)
            while ends is not None:
                part = ends[1 + side]
                known.append((part, ends[0]))
                ends = self.made.get(part)
            self.chains[side][token] = known
        return known

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stand side by side in the encoding of their bytes.

        They do unless two parts meet at the border whose merge comes before the merges that
        end them; of equal merges the left one comes first.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            rank = self.ranks.get
            known = not any((r := rank((a, b))) is not None and r < a_ends and r <= b_ends
                            for a, a_ends in self.edges(left, 1) for b, b_ends in self.edges(right, 0))
            self.pairs[key] = known
        return known

    def byte_prefixes(self, data: bytes) -> list[int]:
        """Tokens of data[:k] for k = 0 ... len(data)."""
        last, count = [b""], [0]
        tokens, longest, pairs, apart = self.tokens, self.longest, self.pairs, self.apart
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = data[start:end]
                if token in tokens:
                    left = last[start]
                    if not start or (pairs[left, token] if (left, token) in pairs else apart(left, token)):
                        last.append(token)
                        count.append(count[start] + 1)
                        break
        return count

    def word_prefixes(self, word: str) -> bytes:
        """Tokens of word[:k] for k = 1 ... len(word), as 32-bit numbers."""
        known = self.words.get(word)
        if known is None:
            data = word.encode()
            count = self.byte_prefixes(data)[1:]
            if len(data) > len(word):  # only where a character ends
                count = [c for c, b in zip(count, data[1:] + b"a") if b & 0xC0 != 0x80]
            if word in CONTRACTIONS:  # cut inside, it is two words
                count[1] = 2
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            known = struct.pack(f"<{len(count)}i", *count)
            if len(word) <= 64:
                self.words[word] = known
        return known

    def _plain(self, text: str) -> np.ndarray:
        """Counts of text[:k] for k = 1 ... len(text); no special string inside."""
        words = self.cut(text)
        if not words:
            return np.empty(0, np.int32)
        parts = [self.words.get(w) or self.word_prefixes(w) for w in words]
        count = np.frombuffer(b"".join(parts), "<i4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        ends = np.cumsum(sizes)
        base = np.zeros(len(parts), np.int32)
        np.cumsum(count[ends[:-1] - 1], out=base[1:])
        count = count + np.repeat(base, sizes)
        for m in self.blanks(text):  # cut behind the run, all of it is one word
            a, b = m.span()
            whole = struct.unpack("<i", self.word_prefixes(text[a:b])[-4:])[0]
            count[b - 1] = (count[a - 1] if a else 0) + whole
        return count

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:k] for k = 0 ... len(text).

        A special string counts as one token where it is complete.
        """
        done, parts = 0, [np.zeros(1, np.int32)]
        rest = self.split(text)
        if len(rest) == 1:
            return np.concatenate([parts[0], self._plain(text)])
        at = 0
        for k, piece in enumerate(rest):
            plain = self._plain(piece)
            parts.append(plain + done)
            # A cut inside behind a run of blanks is the end of the piece, which needs no care.
            done += int(plain[-1]) if len(plain) else 0
            at += len(piece)
            if k + 1 < len(rest):
                name = next(s for s in sorted(self.special, key=len, reverse=True) if text.startswith(s, at))
                whole = self._plain(piece + name)[len(piece):] + (done - (int(plain[-1]) if len(plain) else 0))
                whole = whole.copy()
                done += 1
                whole[-1] = done
                parts.append(whole)
                at += len(name)
        return np.concatenate(parts)


class _Table:
    """Integer keys to small numbers, by open addressing, looked up many at a time."""

    BITS, PROBES = 20, 8

    def __init__(self):
        self.keys = np.zeros((1 << self.BITS) + self.PROBES, np.uint64)
        self.values = np.full(len(self.keys), -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_SPREAD)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> bool:
        """False when a key found no place; such a table has to be made larger."""
        placed = True
        for home, key, value in zip(self._home(keys).tolist(), keys.tolist(), values.tolist()):
            free = next((k for k in range(home, home + self.PROBES) if self.values[k] < 0), None)
            placed &= free is not None
            free = home if free is None else free
            self.keys[free], self.values[free] = key, value
        return placed

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that are not there."""
        home = self._home(keys)
        out = np.where(self.keys[home] == keys, self.values[home], -1)
        open_ = np.flatnonzero((out < 0) & (self.values[home] >= 0))
        for probe in range(1, self.PROBES):
            if not len(open_):
                break
            at = home[open_] + probe
            same = self.keys[at] == keys[open_]
            out[open_[same]] = self.values[at[same]]
            open_ = open_[~same & (self.values[at] >= 0)]
        return out


class BatchCounter:
    """The same counts for many texts at a time, each distinct word of a piece encoded once.

    Written for the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?letters+| ?numbers+| ?others+|blanks``;
    texts that hold a special string, and very long words, go through ``PrefixCounter``.
    """

    def __init__(self, single: PrefixCounter):
        self.single = single
        names = sorted(single.tokens)
        self.names = names
        self.tokens = _Table()
        if not self.tokens.put(_poly(names), np.arange(len(names))):
            raise ValueError("the vocabulary needs a larger table")
        self.pairs = _Table()
        self.longest = single.longest
        #: 0 other, 1 letter, 2 number, 3 blank
        self.kinds = np.zeros(0x110000, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, name in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(name, every):
                self.kinds[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = kind

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(20) | right.astype(np.uint64)
        known = self.pairs.get(keys)
        new = known < 0
        if new.any():
            fresh, inverse = np.unique(keys[new], return_inverse=True)
            names, check = self.names, self.single.apart
            found = np.array([check(names[k >> 20], names[k & 0xFFFFF]) for k in fresh.tolist()], np.int32)
            self.pairs.put(fresh, found)
            known[new] = found[inverse]
        return known > 0

    def encode(self, sums, down, start, length) -> np.ndarray:
        """Tokens of the first j bytes of each word, as [j, word]; words of falling length."""
        most = int(length[0]) if len(length) else 0
        last = np.zeros((most + 1, len(start)), np.int32)
        count = np.zeros((most + 1, len(start)), np.int16)
        active = np.searchsorted(-length, -np.arange(most + 1), side="right")
        for j in range(1, most + 1):
            todo = np.arange(active[j])
            for size in range(1, min(j, self.longest) + 1):
                end = start[todo] + j
                begin = end - size
                token = self.tokens.get((sums[end] - sums[begin]) * down[begin])
                good = token >= 0
                if size < j:
                    at = np.flatnonzero(good)
                    good[at] = self.apart(last[j - size, todo[at]], token[at])
                done = todo[good]
                last[j, done] = token[good]
                count[j, done] = count[j - size, done] + 1
                todo = todo[~good]
                if not len(todo):
                    break
        return count

    def _starts(self, letters, kind, row_start, row_end):
        """Places where words begin, and the runs of blanks that are not one word when something follows."""
        n = len(letters)
        first = np.zeros(n + 1, bool)
        first[row_start] = first[row_end] = True
        before = np.empty(n, np.uint8)
        before[:1], before[1:] = 9, kind[:-1]
        before[row_start[row_start < n]] = 9
        after = np.empty(n, np.uint8)
        after[-1:], after[:-1] = 9, kind[1:]
        after[row_end[(row_end > 0)] - 1] = 9
        blank, space = kind == 3, letters == 32
        first[:-1] |= kind != before
        # The last blank of a run before something else is by itself or, a space, begins the next word.
        split = blank & (after != 3) & (after != 9)
        first[:-1] |= split
        first[np.flatnonzero(split & space) + 1] = False
        quote = np.flatnonzero((letters == 39) & (before != 0) & (after == 1))
        if len(quote):
            quote = quote[(before[quote] != 3) | ~space[np.maximum(quote - 1, 0)]]
            wide = np.append(letters, [0, 0, 0])
            one, two = wide[quote + 1], wide[quote + 2]
            two = np.where((after[np.minimum(quote + 1, n - 1)] == 9), 0, two)
            short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
            long_ = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            first[quote[short | long_] + 1] = False
            first[quote[short] + 2] = True
            first[quote[long_] + 3] = True
        runs = np.flatnonzero(split & (before == 3))
        return first[:n], runs

    def piece(self, data: bytes, offsets: np.ndarray) -> list[np.ndarray]:
        """Counts of each text's prefixes, from 0 characters on. ``offsets`` start at 0."""
        letters = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        rows = np.searchsorted(lead, offsets)  # in characters
        if not len(letters):
            return [np.zeros(1, np.int32) for _ in rows[1:]]
        first, runs = self._starts(letters, self.kinds[letters], rows[:-1], rows[1:])
        byte_at = np.append(lead, len(data))
        begin = np.flatnonzero(first)
        start, end = byte_at[begin], byte_at[np.append(begin[1:], len(letters))]
        # Runs of blanks before something else: the whole run is one more word to encode.
        word_of = np.cumsum(first) - 1
        run_start, run_end = begin[word_of[runs] - 1], runs + 1
        sums, up_down = _sums(data)
        all_start = np.concatenate([start, byte_at[run_start]])
        all_end = np.concatenate([end, byte_at[run_end]])
        key = (sums[all_end] - sums[all_start]) * up_down[all_start]
        _, where, distinct = np.unique(key, return_index=True, return_inverse=True)
        size = all_end[where] - all_start[where]
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        distinct = rank[distinct]
        where, size = where[order], size[order]
        n_long = int(np.searchsorted(-size, -LONG_WORD, side="left"))
        counts = self.encode(sums, up_down, all_start[where[n_long:]], size[n_long:])
        for word in CONTRACTIONS:
            hit = np.flatnonzero(key[where[n_long:]] == _poly([word.encode()])[0])
            if len(hit):
                counts[2, hit] = 2
        total = np.empty(len(where), np.int32)
        total[n_long:] = counts[size[n_long:], np.arange(len(where) - n_long)]
        whole = {k: np.frombuffer(self.single.word_prefixes(data[all_start[w]:all_end[w]].decode()), "<i4")
                 for k, w in enumerate(where[:n_long].tolist())}
        for k, own in whole.items():
            total[k] = own[-1]
        n_words = len(begin)
        mine = distinct[:n_words]
        before = np.concatenate([[0], np.cumsum(total[mine], dtype=np.int64)])
        inside = byte_at[1:] - start[word_of]  # bytes from the word's start to the character's end
        kind_of = mine[word_of] - n_long
        out = before[word_of].copy()
        short = kind_of >= 0
        out[short] += counts[inside[short], kind_of[short]]
        if n_long:
            for w in np.flatnonzero(mine < n_long).tolist():
                low = int(begin[w])
                own = whole[int(mine[w])]
                out[low:low + len(own)] += own
        if len(runs):
            out[runs] = before[word_of[run_start]] + total[distinct[n_words:]]
        base = before[np.append(word_of, n_words)[rows[:-1]]]
        return [np.concatenate([[0], out[a:b] - z]) for a, b, z in zip(rows[:-1], rows[1:], base)]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Prefix counts of each text; null is empty."""
        data, offsets = text_buffers(column)
        low = 0
        while low < len(column):
            high = int(np.searchsorted(offsets, offsets[low] + PIECE, side="right")) - 1
            high = min(max(high, low + 1), len(column))
            own = offsets[low:high + 1]
            raw = data[own[0]:own[-1]].tobytes()
            special = self._with_special(raw, own - own[0])
            if len(raw) > PIECE and not special:  # one long text
                yield self._long(raw)
            else:
                for k, counts in enumerate(self.piece(raw, own - own[0])):
                    if k in special:
                        counts = self.single.prefixes(raw[own[k] - own[0]:own[k + 1] - own[0]].decode())
                    yield counts
            low = high

    def _long(self, raw: bytes) -> np.ndarray:
        """Counts of a long text, a piece at a time; pieces begin where the pattern always cuts."""
        cuts = [0]
        while len(raw) - cuts[-1] > PIECE and (found := SAFE_CUT.search(raw, cuts[-1] + PIECE)):
            cuts.append(found.start())
        parts, done = [np.zeros(1, np.int64)], 0
        for a, b in zip(cuts, [*cuts[1:], len(raw)]):
            counts = self.piece(raw[a:b], np.array([0, b - a]))[0]
            parts.append(counts[1:] + done)
            done += int(counts[-1])
        return np.concatenate(parts)

    def _with_special(self, raw: bytes, offsets: np.ndarray) -> set[int]:
        rows = set()
        for name in self.single.special:
            at = raw.find(name.encode())
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = raw.find(name.encode(), at + 1)
        return rows


def _sums(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial over bytes, and the factors that bring a span back to place 0."""
    up, down = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[np.frombuffer(data, np.uint8)] * up[:-1], out=sums[1:])
    return sums, down


def _poly(words: list[bytes]) -> np.ndarray:
    """The same polynomial of whole words."""
    data, ends = b"".join(words), np.cumsum([len(w) for w in words])
    sums, down = _sums(data)
    starts = np.append(0, ends[:-1])
    return (sums[ends] - sums[starts]) * down[starts]


def _byte_of_letter() -> dict[str, int]:
    """The usual letters for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(others)}}


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> BatchCounter:
    """Read once in a worker."""
    return BatchCounter(PrefixCounter(path, pattern))


def pack(counts: np.ndarray) -> bytes:
    """Differences of neighbours, in as few bytes as they fit in, compressed."""
    steps = np.diff(counts)
    small = not len(steps) or (steps.min() >= -128 and steps.max() <= 127)
    return (b"1" if small else b"4") + zlib.compress(steps.astype("i1" if small else "<i4").tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    """Counts at every prefix, from 0 characters to all."""
    steps = np.frombuffer(zlib.decompress(data[1:]), "i1" if data[:1] == b"1" else "<i4")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def longest_prefix(data: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    return int(np.flatnonzero(unpack(data) <= budget)[-1])


def _count(batches: Iterator[pa.RecordBatch], path: str, pattern: str, at: int, schema):
    own = counter(path, pattern)
    for batch in batches:
        sizes = np.diff(text_buffers(batch.column(at))[1])
        tokens, stored = [], []
        for counts in own.texts(batch.column(at)):
            tokens.append(int(counts[-1]))
            stored.append(pack(counts))
        columns = [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(stored, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=schema)


def count_prefixes(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``prefix_counts`` (see ``unpack``).

    ``path``: a byte-level BPE file that every executor has; ``pattern``: how it cuts words.
    Counts are those of the file's own library without added special tokens.

    Null text is empty: 0 bytes, 0 tokens, one prefix. Texts of any length are
    counted whole. Repeated rows are counted each by itself, an empty table stays empty,
    and columns with the names of the result are replaced.
    """
    base = without(docs, *(c for c in ADDED if c != text))
    at = base.columns.index(text)
    schema = T.StructType([*base.schema.fields, T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()),
                           T.StructField("prefix_counts", T.BinaryType())])
    return map_rows(base, lambda b, arrow: _count(b, path, pattern, at, arrow), schema)


def within_budget(counted: DataFrame, budget: int) -> DataFrame:
    """Adds ``fits`` (characters of the longest prefix within ``budget`` tokens), from stored counts."""
    counted = without(counted, "fits")
    at = counted.columns.index("prefix_counts")
    schema = T.StructType([*counted.schema.fields, T.StructField("fits", T.LongType())])

    def fit(batches, arrow):
        for batch in batches:
            fits = [longest_prefix(data.as_py(), budget) for data in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fits, pa.int64())], schema=arrow)

    return map_rows(counted, fit, schema)

"""Weighted means of vectors for a group of samples: the Arrow functions of ``vectors.pool_tokens``.

A sample is ``id, words, counts``: its different tokens with a blank between them (no token holds one), and a byte for each
that says how often it comes; a token that comes more often than a byte can say is written again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers that are held at a time, to be added up, and those of vectors that are put into bundles at a time.
SLICE, BUNDLE = 1 << 20, 1 << 22
#: Tokens that are counted, and samples that are pooled at a time.
TOKENS, SAMPLES = 1 << 20, 1 << 12


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def counted_words(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From ``group, id, tokens`` to ``group, id, words, counts``; both are null where there is no token."""
    for batch in batches:
        upto, start = np.cumsum(_lengths(batch.column(2))), 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = max(int(np.searchsorted(upto, before + TOKENS, "right")), start + 1)
            part, start = batch.slice(start, end - start), end
            yield pa.record_batch([*(part.column(k).cast(schema.field(k).type) for k in range(2)), *_counted(
                part.column(2))], schema=schema)


def _counted(lists: pa.ListArray) -> list[pa.Array]:
    sizes = _lengths(lists)
    tokens = pc.dictionary_encode(lists.flatten())
    kinds = max(len(tokens.dictionary), 1)
    pairs, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * kinds + tokens.indices.to_numpy().astype(
        np.int64), return_counts=True)
    times = -(-n // 255)
    pairs = np.repeat(pairs, times)
    counts = np.full(len(pairs), 255, np.uint8)
    counts[np.cumsum(times) - 1] = n - 255 * (times - 1)
    offsets = np.searchsorted(pairs, np.arange(len(sizes) + 1) * kinds)
    none = offsets[1:] == offsets[:-1]
    words = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), tokens.dictionary.take(
        pa.array(pairs % kinds))), " ")
    data = counts.tobytes()
    return [pc.if_else(pa.array(none), pa.scalar(None, words.type), words), pa.array(
        [None if x else data[a:b] for x, a, b in zip(none, offsets[:-1], offsets[1:])], pa.binary())]


def group_words(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From all samples of some groups (group, id, words, counts) to ``group, token``, each token once for a group."""
    found = defaultdict(list)
    for batch in batches:
        for group in pc.unique(batch.column(0)):
            own = batch.column(2).filter(pc.equal(batch.column(0), group))
            found[group.as_py()].append(pc.unique(pc.split_pattern(own.drop_null(), " ").flatten()))
    for group, parts in found.items():
        tokens = pc.unique(pa.chunked_array(parts))
        for k in range(0, len(tokens), TOKENS):
            own = tokens.slice(k, TOKENS)
            yield pa.record_batch([pa.repeat(pa.scalar(group, schema.field(0).type), len(own)), own], schema=schema)


def bundled_vectors(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From ``group, token, vector`` to ``group, words, n, size, vectors``: as many vectors as are held at a time make a
    bundle for each group, the numbers' first bytes before their second ones, and so on, and compressed."""
    held, numbers = [], 0
    for batch in batches:
        held, numbers = [*held, batch], numbers + len(batch.column(2).flatten())
        if numbers >= BUNDLE:
            yield from _bundles(held, schema)
            held, numbers = [], 0
    yield from _bundles(held, schema)


def _bundles(batches: list[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    group, token, vector = pa.Table.from_batches(batches).combine_chunks().itercolumns()
    size = len(vector[0])
    if pc.any(pc.not_equal(pc.list_value_length(vector), size)).as_py():
        raise ValueError("vectors are not of one size")
    table = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vector.chunks]).reshape(len(vector), size)
    group = group.to_numpy()
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.diff(group[order], prepend=group[order[0]] - 1))
    rows = []
    for a, b in zip(edges, [*edges[1:], len(order)]):
        own = np.ascontiguousarray(table[order[a:b]])
        planes = own.view(np.uint8).reshape(-1, own.itemsize).T.tobytes()
        rows.append((int(group[order[a]]), " ".join(token.take(pa.array(order[a:b])).to_pylist()), int(b - a), size, pa.compress(
            planes, "zstd", asbytes=True)))
    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def pooled_means(samples: pa.Table, bundles: pa.Table, schema: pa.Schema, kind: str = "f4") -> pa.Table:
    """From samples (group, id, words, counts) and bundles of vectors of a kind of number (group, words, n, size, vectors) to
    ``id, embedding``, a row for each sample. Rows of one id have the mean of all of them, and one without any vector has
    none; a token with several vectors samples with each. Vectors stay compressed but for one bundle."""
    ids = samples.column(1).combine_chunks()
    codes = pc.dictionary_encode(ids, null_encoding="encode")
    of = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes, many = set(bundles.column("size").to_pylist()), bundles.column("n").to_numpy().astype(np.int64)
    if len(sizes) > 1:
        raise ValueError("vectors are not of one size")
    size, starts, at = max(sizes, default=0), _offsets(many), 0
    sums, weight = np.zeros((len(codes.dictionary), size)), np.zeros(len(codes.dictionary))
    if size:
        names = pc.list_flatten(pc.split_pattern(bundles.column("words"), " "))
        distinct = pc.unique(names)
        place = pc.index_in(names, distinct).to_numpy()
        order, times = np.argsort(place, kind="stable"), np.bincount(place, minlength=len(distinct))
        first, data = _offsets(times), [c for chunk in bundles.column("vectors").chunks for c in chunk]
        for batch in samples.to_batches(max_chunksize=SAMPLES):
            words = pc.split_pattern(batch.column(2), " ")
            found = pc.index_in(words.flatten(), distinct)
            known = pc.is_valid(found).to_numpy(zero_copy_only=False)
            n = np.frombuffer(b"".join(batch.column(3).drop_null().to_pylist()), np.uint8)[known].astype(np.float64)
            row, token = np.repeat(np.arange(batch.num_rows), _lengths(words))[known], found.drop_null().to_numpy()
            # A row for each vector of a token; samples stay in order.
            copies = times[token]
            turn = np.arange(copies.sum()) - np.repeat(_offsets(copies)[:-1], copies)
            vector, row, n = order[np.repeat(first[token], copies) + turn], np.repeat(row, copies), np.repeat(n, copies)
            own, by = np.zeros((batch.num_rows, size)), np.argsort(vector, kind="stable")
            cuts = np.searchsorted(vector[by], starts)
            for k in np.flatnonzero(np.diff(cuts)):
                planes = np.frombuffer(pa.decompress(data[k].as_buffer(), int(many[k]) * size * np.dtype(kind).itemsize, "zstd"), np.uint8)
                table = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1, size)
                for a in range(cuts[k], cuts[k + 1], step := max(SLICE // size, 1)):
                    part = np.sort(by[a:min(a + step, cuts[k + 1])])
                    edges = np.flatnonzero(np.diff(row[part], prepend=-1))
                    own[row[part][edges]] += np.add.reduceat(table[vector[part] - starts[k]] * n[part, None], edges)
            mine, at = of[at:at + batch.num_rows], at + batch.num_rows
            np.add.at(sums, mine, own)
            np.add.at(weight, mine, np.bincount(row, n, batch.num_rows))
    has = weight[of] > 0
    means = sums[of[has]] / weight[of[has], None]
    embedding = pa.ListArray.from_arrays(pa.array(_offsets(has * size).astype(np.int32)), pa.array(means.ravel()), mask=pa.array(~has))
    return pa.table([ids.cast(schema.field(0).type), embedding.cast(schema.field(1).type)], schema=schema)

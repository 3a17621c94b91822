"""The nodes of token arrays, for ``mapInArrow``: batches of samples in, batches of samples with their nodes out.

``block_nodes`` and ``placed_nodes`` do the same for blocks of a text (see operators.blocks): what a block knows by
itself, and its nodes once it is known what is before it and where its open nodes end. ``node_lines`` writes nodes.

A batch is worked on in slices of so many tokens (a longer sample is a slice of its own), so what a task holds does
not follow the size of its partition.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens of a slice.
SLICE = 1 << 18


def packed_nodes(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From ``sample_id, root, tokens`` (and ``code``, where tokens have texts) to ``sample_id, nodes``."""
    for part, sizes in _slices(batches, 2):
        yield pa.record_batch([part.column(0).cast(schema.field(0).type), _nodes(part, sizes).cast(
            schema.field(1).type)], schema=schema)


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows whose arrays in a column (or those of as many elements as it says) have ``SLICE`` elements or less together, or
    one row, with the arrays' sizes."""
    for batch in batches:
        given = batch.column(column)
        sizes = _int(given) if pa.types.is_integer(given.type) else _sizes(given)
        upto, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            done = upto[start] - sizes[start]
            end = max(int(np.searchsorted(upto, done + SLICE, "right")), start + 1)
            yield batch.slice(start, end - start), sizes[start:end]
            start = end


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _fields(lists: pa.ListArray) -> dict[str, pa.Array]:
    """The fields of all structs in an array of structs."""
    flat = lists.flatten()
    return dict(zip([f.name for f in flat.type], flat.flatten()))


def _int(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(offsets: np.ndarray, columns: dict[str, pa.Array | np.ndarray], kind: pa.ListType) -> pa.Array:
    made = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(
        made, names=list(columns))).cast(kind)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _coded(sizes: np.ndarray, columns: list[np.ndarray], types: pa.Array) -> tuple[pa.Array, pa.Array]:
    """For rows of so many nodes, their numbers as bytes, and the different types of each: a row's last number of a node is
    the place of its type in those. The bytes begin with the width of each column."""
    own = pc.dictionary_encode(types, null_encoding="encode")
    owner, kinds = np.repeat(np.arange(len(sizes)), sizes), max(len(own.dictionary), 1)
    pairs, place = np.unique(owner * kinds + _int(own.indices), return_inverse=True)
    first = np.searchsorted(pairs, np.arange(len(sizes) + 1) * kinds)
    narrow = [c.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= c.min(
        initial=0) and c.max(initial=0) <= np.iinfo(t).max)) for c in (*columns, place - first[owner])]
    head, offsets = bytes(c.itemsize for c in narrow), _offsets(sizes)
    made = [zlib.compress(b"".join([head, *(c[a:b].tobytes() for c in narrow)])) for a, b in zip(offsets[:-1], offsets[1:])]
    return pa.array(made, pa.binary()), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), own.dictionary.take(
        pa.array(pairs % kinds)))


def _decoded(made: pa.Array, sizes: np.ndarray, types: pa.ListArray, n: int) -> tuple[list[np.ndarray], pa.Array]:
    """The ``n`` columns of numbers and the types that ``_coded`` was given."""
    columns, offsets = [np.empty(int(sizes.sum()), np.int64) for _ in range(n + 1)], _offsets(sizes)
    for row, a, b in zip(made, offsets[:-1], offsets[1:]):
        data, at = zlib.decompress(row.as_py()), n + 1
        for c, width in zip(columns, data):
            c[a:b] = np.frombuffer(data, f"i{width}", b - a, at)
            at += width * (b - a)
    return columns[:n], types.flatten().take(pa.array(columns[n] + np.repeat(_offsets(_sizes(types))[:-1], sizes)))


def _steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Differences, from 0, within each row."""
    made, first = np.diff(values, prepend=0), _offsets(sizes)[:-1][sizes > 0]
    made[first] = values[first]
    return made


def _sums(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values that ``_steps`` was given."""
    sums = _offsets(steps)
    return sums[1:] - np.repeat(sums[_offsets(sizes)[:-1]], sizes)


def _passed(below: np.ndarray, size: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes that the nodes before a node in its row have passed over, if those without any below them are the text: starts
    are written less these, so that few are other than 0 or 1."""
    sums = _offsets(np.where(below == 0, size, 0))
    return sums[:-1] - np.repeat(sums[_offsets(sizes)[:-1]], sizes)


def _nodes(batch: pa.RecordBatch, sizes: np.ndarray) -> pa.Array:
    tokens = batch.column(2).flatten()
    fields = dict(zip([f.name for f in tokens.type], tokens.flatten()))
    step, n_bytes, is_node = (fields[c].to_numpy(zero_copy_only=False).astype(np.int64)
                              for c in ("step", "n_bytes", "is_node"))
    n, total = len(sizes), len(step)
    owner = np.repeat(np.arange(n), sizes)
    ends = np.cumsum(sizes)

    def before(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the earlier tokens of the sample add up to, and all of them."""
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[:-1] - sums[(ends - sizes)][owner], sums[ends] - sums[ends - sizes]

    sums, _ = before(step)
    seen, nodes = before(is_node)
    at, size = before(n_bytes)
    # The level never sinks below 0: take off what stray closes took from the sum. Samples are set apart, so that the
    # lowest point of one starts above those of the next.
    apart = owner * (2 * total + 2)
    level = sums - np.minimum(np.minimum.accumulate(sums - apart) + apart, 0)

    # A close ends the open node of its level: the next bracket of that level in the sample, or else the text does.
    opens, closes = step == 1, (step == -1) & (level > 0)
    brackets = np.flatnonzero(opens | closes)
    own = np.where(opens, level + 1, level)[brackets]
    order = np.lexsort((own, owner[brackets]))
    b, own = brackets[order], own[order]
    ended = np.zeros(len(b), bool)
    if len(b):
        ended[:-1] = (owner[b][1:] == owner[b][:-1]) & (own[1:] == own[:-1])
    after = np.roll(b, -1)
    below, end = np.zeros(total, np.int64), at + n_bytes
    below[b] = np.where(ended, seen[after], nodes[owner[b]]) - seen[b] - 1
    end[b] = np.where(ended, at[after] + n_bytes[after], size[owner[b]])

    # Nodes in preorder, the root of each sample first.
    kept = np.flatnonzero(opens | ((is_node == 1) & ~closes))
    who = owner[kept]
    offsets = np.concatenate([[0], np.cumsum(nodes + 1)])
    spot, roots = np.arange(len(kept)) + who + 1, offsets[:-1]

    def column(inner: np.ndarray, root) -> np.ndarray:
        made = np.empty(len(kept) + n, np.int64)
        made[spot], made[roots] = inner, root
        return made

    pre, depth = column(seen[kept] + 1, 0), column(level[kept] + 1, 0)
    below = column(np.where(opens, below, 0)[kept], nodes)
    # Children are the nodes one level down in the ranks below a node.
    tree, deep, wide = column(who, np.arange(n)), int(depth.max(initial=0)) + 2, int(nodes.max(initial=0)) + 1
    places = np.sort((tree * deep + depth) * wide + pre)
    first = (tree * deep + depth + 1) * wide + pre
    children = np.searchsorted(places, first + below, "right") - np.searchsorted(places, first, "right")

    def text(inner: pa.Array, root: pa.Array) -> pa.Array:
        which = column(kept + n, np.arange(n))
        return pa.concat_arrays([root, inner]).take(pa.array(which))

    ints = {"pre": pre, "post": pre + below - depth, "depth": depth, "n_children": children}
    spans = {"start_byte": column(at[kept], 0), "end_byte": column(np.where(opens, end, at + n_bytes)[kept], size)}
    made = {k: pa.array(v.astype(np.int32)) for k, v in ints.items()}
    made["type"] = text(fields["type"], batch.column(1))
    made |= {k: pa.array(v.astype(np.int32)) for k, v in spans.items()}
    if "text" in fields:  # that of leaves, and of a root without children
        made["text"] = text(fields["text"], batch.column(3).take(pa.array(np.arange(n), mask=nodes > 0)))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(
        list(made.values()), names=list(made)))


def block_nodes(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From ``sample_id, block, root, tokens`` to ``sample_id, block, root``, how many nodes, bytes, open closes and open
    opens a block has, its ``nodes`` as bytes and their ``types``, those of them that do not end in it (``halves``), and its
    ``ends``: open closes and the end of the block.

    ``lows``: open closes before the node or end; ``height``: level of its parent above the lowest point so far. A node
    that does not end in the block has -1 for ``below`` and ``end``, and the children that the block has of it; an end
    has those that the node at the lowest level has got since the last one.
    """
    for part, sizes in _slices(batches, 3):
        made = _block_nodes(part.column(3), sizes, schema)
        yield pa.record_batch([part.column(k).cast(schema.field(k).type) for k in range(3)] + made, schema=schema)


def _block_nodes(tokens: pa.ListArray, sizes: np.ndarray, schema: pa.Schema) -> list[pa.Array]:
    fields = _fields(tokens)
    step, n_bytes, is_node = (_int(fields[c]) for c in ("step", "n_bytes", "is_node"))
    n, total = len(sizes), len(step)
    owner, ends = np.repeat(np.arange(n), sizes), np.cumsum(sizes)

    def before(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = _offsets(x)
        return sums[:-1] - sums[ends - sizes][owner], sums[ends] - sums[ends - sizes]

    sums, _ = before(step)
    seen, nodes = before(is_node)
    at, size = before(n_bytes)
    apart = owner * (2 * total + 2)
    low = np.minimum(np.minimum.accumulate(sums - apart) + apart, 0)
    lows, height = -low, sums - low
    opens, closes, over = step == 1, (step == -1) & (height > 0), (step == -1) & (height == 0)
    lowered, _ = before(over.astype(np.int64))
    n_over = np.bincount(owner[over], minlength=n)
    # Stretches without an open close, numbered through.
    stretch = lowered + _offsets(n_over + 1)[:-1][owner]

    # An open node ends with the next bracket of its level, if that is in the block.
    brackets = np.flatnonzero(opens | closes)
    own = np.where(opens, height + 1, height)[brackets]
    order = np.lexsort((own, owner[brackets]))
    b, own = brackets[order], own[order]
    ended = np.zeros(len(b), bool)
    if len(b):
        ended[:-1] = (owner[b][1:] == owner[b][:-1]) & (own[1:] == own[:-1])
    close = np.full(total, total, np.int64)
    close[b] = np.where(ended, np.roll(b, -1), total)
    kept = np.flatnonzero(opens | ((is_node == 1) & (step == 0)))
    half = opens[kept] & (close[kept] == total)
    last = np.where(half | ~opens[kept], kept, close[kept] % max(total, 1))
    below = np.where(opens[kept], seen[last] - seen[kept] - 1, 0)

    # Children stand one level higher in the same stretch, up to the close.
    deep, wide = int(height.max(initial=0)) + 2, total + 1
    places = np.sort((stretch[kept] * deep + height[kept]) * wide + kept)
    first = (stretch[kept] * deep + height[kept] + 1) * wide
    children = np.where(opens[kept], np.searchsorted(places, first + close[kept]) - np.searchsorted(
        places, first + kept), 0)

    # Ends of a block: its open closes, then its own.
    who = np.concatenate([owner[over], np.arange(n)])
    turn = np.argsort(who, kind="stable")
    rest = np.concatenate([np.zeros(len(who) - n, bool), np.ones(n, bool)])[turn]
    lowest = np.arange(len(who)) * deep * wide
    spans = {"lows": np.concatenate([lows[over], n_over])[turn], "seen": np.concatenate([seen[over], nodes])[turn],
             "to_byte": np.concatenate([(at + n_bytes)[over], size])[turn],
             "n_children": np.searchsorted(places, lowest + wide) - np.searchsorted(places, lowest), "is_rest": rest}
    columns = {"seen": seen[kept] + 1, "lows": lows[kept], "height": height[kept], "n_children": children}
    n_kept, n_half = (np.bincount(x, minlength=n) for x in (owner[kept], owner[kept][half]))
    below, size_of = np.where(half, -1, below), np.where(half, 0, at[last] + n_bytes[last] - at[kept])
    coded, types = _coded(n_kept, [
        *(_steps(c[kept], n_kept) for c in (seen, lows, height)), below, children,
        _steps(at[kept] - _passed(below, size_of, n_kept), n_kept), size_of], fields["type"].take(pa.array(kept)))
    return [*(pa.array(c.astype(np.int64)) for c in (nodes, size, n_over, n_half, n_kept)), coded,
            types.cast(schema.field("types").type), _lists(_offsets(n_half), {c: columns[c][half] for c in ("seen", "lows", "height", "n_children")},
                   schema.field("halves").type),
            _lists(_offsets(n_over + 1), spans, schema.field("ends").type)]


def placed_nodes(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From blocks of ``block_nodes`` with ``level, nodes_before, bytes_before`` and ``late`` (by rank, what is below the
    nodes that end in no block of their own, their children and ends; rank 0 is the root) to ``sample_id, nodes``."""
    names = ("sample_id", "root", "level", "nodes_before", "bytes_before", "late", "nodes", "types", "n_kept")
    for part, sizes in _slices(batches, len(names) - 1):
        sample_id, root, level, nodes_before, bytes_before, late, nodes, types, _ = part.columns
        yield pa.record_batch([sample_id.cast(schema.field(0).type), _placed(
            root, *map(_int, (level, nodes_before, bytes_before)), late, nodes, types, sizes, schema.field(1).type)],
            schema=schema)


def _placed(root: pa.Array, level: np.ndarray, nodes_before: np.ndarray, bytes_before: np.ndarray, late: pa.ListArray,
            nodes: pa.Array, types: pa.ListArray, sizes: np.ndarray, kind: pa.ListType) -> pa.Array:
    n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    (seen, lows, height, below, children, start, size), types = _decoded(nodes, sizes, types, 7)
    seen, lows, height, start = (_sums(c, sizes) for c in (seen, lows, height, start))
    pre, depth = nodes_before[owner] + seen + 1, np.maximum(level[owner] - lows, 0) + height + 1
    start += bytes_before[owner] + _passed(below, size, sizes)
    end = start + size
    given, of = _fields(late), np.repeat(np.arange(n), _sizes(late))
    rank, more, kids, upto = (_int(given[c]) for c in ("pre", "below", "n_children", "end_byte"))
    order = np.lexsort((rank, of))
    roots, order = order[rank[order] == 0], order[rank[order] > 0]
    half = np.flatnonzero(below < 0)
    if not np.array_equal(pre[half], rank[order]):
        raise ValueError("the ends of a block's open nodes are not known")
    below[half], children[half], end[half] = more[order], kids[order], upto[order]

    has_root = np.bincount(of[roots], minlength=n)
    offsets = _offsets(sizes + has_root)
    spot, first = np.arange(len(owner)) + np.cumsum(has_root)[owner], offsets[:-1][of[roots]]

    def column(inner: np.ndarray, of_root) -> np.ndarray:
        made = np.empty(len(owner) + len(roots), np.int64)
        made[spot], made[first] = inner, of_root
        return made

    pre, depth, below = column(pre, 0), column(depth, 0), column(below, more[roots])
    types = pa.concat_arrays([root, types]).take(pa.array(column(np.arange(len(owner)) + n, of[roots])))
    return _lists(offsets, {
        "pre": pre, "post": pre + below - depth, "depth": depth, "n_children": column(children, kids[roots]),
        "type": types, "start_byte": column(start, 0), "end_byte": column(end, upto[roots])}, kind)


def node_stretches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From ``sample_id, nodes`` to ``sample_id``, the rank of the first of the nodes, how many there are, and the nodes as
    bytes with their types; rows without nodes are left out."""
    for part, sizes in _slices(batches, 1):
        part, sizes = part.filter(pa.array(sizes > 0)), sizes[sizes > 0]
        if len(sizes):
            own = _fields(part.column(1))
            pre, post, depth, children, start, end = (_int(own[c]) for c in (
                "pre", "post", "depth", "n_children", "start_byte", "end_byte"))
            first, below, size = _offsets(sizes)[:-1], post - pre + depth, end - start
            coded = _coded(sizes, [_steps(pre, sizes), below, _steps(depth, sizes), children, _steps(start - _passed(
                below, size, sizes), sizes), size], own["type"])
            columns = [part.column(0), pa.array(pre[first]), pa.array(sizes), *coded]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def stretch_digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From rows of ``node_stretches``, those of a sample in a row and by rank, to ``sample_id``, how many nodes it has and
    the SHA-256 of their lines (see ``trees.node_digest``). Lines are held for a slice of nodes only."""
    last, total, digest = None, 0, None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for part, sizes in _slices(batches, 2):
        (pre, below, depth, children, start, size), types = _decoded(part.column(3), sizes, part.column(4), 6)
        pre, depth, start = (_sums(c, sizes) for c in (pre, depth, start))
        start += _passed(below, size, sizes)
        text = lambda c: pa.array(c).cast(pa.string())
        lines = pc.binary_join_element_wise(*map(text, (pre, pre, pre + below - depth, depth, children)), pc.fill_null(
            types, ""), *map(text, (start, start + size)), ":")
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(_offsets(sizes).astype(np.int32)), lines), "\n")
        done = []
        for sample_id, n, line in zip(part.column(0).to_pylist(), sizes.tolist(), joined):
            if digest and sample_id == last:
                digest.update(b"\n")
            else:
                if digest:
                    done.append((last, total, digest.hexdigest()))
                last, total, digest = sample_id, 0, hashlib.sha256()
            digest.update(line.as_buffer())
            total += n
        if done:
            yield made(done)
    if digest:
        yield made([(last, total, digest.hexdigest())])

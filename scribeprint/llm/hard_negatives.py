"""Hard negatives by score windows, read from blocks in the order of a Hilbert curve with zone maps.

Candidates are stored as Parquet rows of up to ``BLOCK_ROWS`` vectors each: first by length and label, then along a
Hilbert curve through the cells of their components (the components that vary most lead), then by id. A block
keeps the least and the greatest value of each dimension. A stretch of blocks is an area with a zone map of its own.

Anchors are stored the same way, in groups. The inner product of an anchor with a vector of a block lies between
sums over the dimensions of the least and the greatest product (interval arithmetic). So

1. each group is joined with the areas whose bounds reach it, by zone maps alone, and only then with their blocks;
2. in a task, a block is read for the anchors whose windows its bounds meet and that could still gain from it,
   given what they have found: the ten best of a window end it. Exact products of those follow.

It is done once for the positives (the window is all scores of the same label) and once for the negatives
(a window per positive). Each area gives at most as many rows per window as are asked for; a ranking
per window merges them. Groups meet blocks, never rows meet rows in a join, and nothing is dropped.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribeprint.llm.scratch import map_rows, written

SCALE = 256
EVERY = 100
POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
#: Rows of a block, of an area, and of a group of anchors.
BLOCK_ROWS, AREA_ROWS, GROUP_ROWS = 2048, 1 << 20, 256
#: Dimensions that the curve goes through, and cells of each as a power of two.
CURVE_DIMS, CURVE_BITS = 32, 2
_LAST = np.iinfo(np.int64).max
_KINDS = ("<i2", "<i4", "<i8")
BLOCK = ("area long, block long, dims long, label long, n long, kind string, ids array<long>, vectors binary, "
         "low array<long>, high array<long>")
#: Sums of products up to here are exact in doubles; scores are less than the second.
_EXACT, _NO_LIMIT = 1 << 53, 1 << 62
#: Shares of areas that zone maps are joined in, and groups whose finds a task holds at once.
SHARES, HELD = 64, 64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the curve, as bytes in sort order, of points with coordinates below 2^bits (one row a point)."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    top = np.uint32(1 << (bits - 1))
    q = top
    while q > 1:  # undo the turns of each level
        low = np.uint32(q - 1)
        for i in range(n):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    q = top
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - np.uint32(1), 0).astype(np.uint32)
        q >>= np.uint32(1)
    x ^= turn
    levels = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(levels).T.astype(np.uint8), axis=1)


def usable_rows(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """``id, label, v``: rows with a label and a finite vector; ``v`` in whole numbers."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    own = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                    F.col(vector).cast("array<double>").alias("v"))
    own = own.filter(F.col("label").isNotNull() & F.col("v").isNotNull()).filter(F.forall("v", real))
    return own.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if dims else np.empty((len(column), 0), np.int64)


def _spread(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of each dimension, by vector length: a pair of numbers a dimension comes to the driver."""
    def add(batches, arrow):
        sums: dict[int, list] = {}
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                v = _matrix(batch.column(0).filter(pa.array(sizes == dims)), dims).astype(np.float64)
                own = sums.setdefault(dims, [0, np.zeros(dims), np.zeros(dims)])
                own[0], own[1], own[2] = own[0] + len(v), own[1] + v.sum(0), own[2] + (v * v).sum(0)
        for dims, (n, one, two) in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([dims] * dims, pa.int64()), pa.array(range(dims), pa.int64()), pa.array([float(n)] * dims, pa.float64()),
                pa.array(one, pa.float64()), pa.array(two, pa.float64())], schema=arrow)

    summed = map_rows(rows.select("v"), add, T.StructType.fromDDL("dims long, k long, n double, one double, two double"))
    found: dict[int, list] = {}
    for r in summed.groupBy("dims", "k").agg(F.sum("n"), F.sum("one"), F.sum("two")).orderBy("dims", "k").collect():
        mean = r[3] / r[2]
        found.setdefault(r["dims"], []).append((mean, max(r[4] / r[2] - mean * mean, 0.0) ** 0.5))
    return {dims: tuple(np.array(x) for x in zip(*own)) for dims, own in found.items()}


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``dims`` and ``curve``, the place on the curve."""
    spread = _spread(rows)

    def run(batches, arrow):
        for batch in batches:
            vectors = batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            keys = np.full(len(batch), b"", object)
            for dims in np.unique(sizes[sizes > 0]).tolist():
                mean, deviation = spread[dims]
                lead = np.argsort(-deviation, kind="stable")[:CURVE_DIMS]
                mine = np.flatnonzero(sizes == dims)
                v = (_matrix(vectors.take(pa.array(mine)), dims)[:, lead] - mean[lead]) / np.maximum(deviation[lead], 1e-9)
                cells = np.clip(np.floor(v * (1 << CURVE_BITS) / 3) + (1 << CURVE_BITS) // 2, 0, (1 << CURVE_BITS) - 1)
                packed = hilbert_keys(cells, CURVE_BITS)
                keys[mine] = [k.tobytes() for k in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())],
                                             schema=arrow)

    schema = T.StructType([*rows.schema.fields, T.StructField("dims", T.LongType()), T.StructField("curve", T.BinaryType())])
    return map_rows(rows, run, schema)


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, size: int):
    """Input: area, id, label, vector, length in order. Output: blocks of one length and label."""
    number, held = 0, []

    def closed():
        area, _, label, _, dims = held[0]
        v = np.array([h[3] for h in held], np.int64).reshape(len(held), dims)
        kind = next(k for k in _KINDS if not v.size or (v.min() >= np.iinfo(k).min and v.max() <= np.iinfo(k).max))
        row = [area, number, dims, label, len(held), kind, [h[1] for h in held], v.astype(kind).tobytes(),
               v.min(0).tolist(), v.max(0).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (len(held) == size or (row[2], row[4]) != (held[0][2], held[0][4])):
                yield closed()
                number, held = number + 1, []
            held.append(row)
    if held:
        yield closed()


def stored_blocks(keyed: DataFrame, n_rows: int, size: int, area_rows: int, name: str) -> DataFrame:
    """Blocks in curve order, as a Parquet table. A partition of the sort is an area."""
    tasks = keyed.sparkSession.sparkContext.defaultParallelism
    n_areas = max(1, -(-n_rows // area_rows), min(2 * tasks, -(-n_rows // size)))
    order = ["dims", "label", "curve", F.col("id").asc_nulls_last()]
    ordered = keyed.repartitionByRange(n_areas, *order).sortWithinPartitions(*order)
    rows = ordered.select(F.spark_partition_id().cast("long").alias("area"), "id", "label", "v", "dims")
    return written(map_rows(rows, lambda b, arrow: _blocks(b, arrow, size), T.StructType.fromDDL(BLOCK)), name)


def _zones(blocks: DataFrame, *keys: str) -> DataFrame:
    """Zone maps of areas or groups: ``low`` and ``high`` of each dimension, for each length and label in them."""
    each = blocks.select(*keys, "dims", "label", F.posexplode_outer(F.arrays_zip("low", "high")).alias("k", "z"))
    return (each.groupBy(*keys, "dims", "label", "k").agg(F.min("z.low").alias("low"), F.max("z.high").alias("high"))
            .groupBy(*keys, "dims", "label").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("z"))
            .select(*keys, "dims", "label", F.expr("filter(z, x -> x.k is not null)").alias("z")))


def _bound(greatest: bool):
    """Greatest (least) inner product of two zones."""
    ends = [f"{a} * {b}" for a in ("cast(p.a.low as double)", "cast(p.a.high as double)")
            for b in ("cast(p.b.low as double)", "cast(p.b.high as double)")]
    choose = "greatest" if greatest else "least"
    return F.expr(f"aggregate(arrays_zip(a, b), 0D, (s, p) -> s + {choose}({', '.join(ends)}))")


def reached(groups: DataFrame, areas: DataFrame, same_label: bool) -> DataFrame:
    """``grp, area, label``: areas whose zone maps meet a window of the group. ``groups``: with windows ``least, most``.

    A stated set of queries in groups against areas: each group is dealt to all shares of the areas. Only zone
    maps move.
    """
    a = groups.select("grp", "dims", F.col("label").alias("own"), F.col("z").alias("a"), "least", "most",
                      F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    b = areas.select("area", "dims", "label", F.col("z").alias("b"), (F.col("area") % SHARES).cast("int").alias("share"))
    met = a.join(b, ["dims", "share"]).filter((F.col("label") == F.col("own")) == F.lit(same_label))
    slack = F.lit(0.5)  # bounds are sums of doubles; exact products are whole numbers
    met = met.withColumn("up", _bound(True)).withColumn("down", _bound(False))
    met = met.filter((F.col("up") + slack + F.abs("up") * 1e-12 >= F.col("least"))
                     & (F.col("down") - slack - F.abs("down") * 1e-12 <= F.col("most")))
    return met.select("grp", "area", "label").distinct()


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles where they hold them, else by integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= _NO_LIMIT:
        raise OverflowError("inner products beyond 62 bits")
    return a @ b.T


class _Windows:
    """The best rows that each anchor of a group has found so far in each of its windows."""

    def __init__(self, ids, v, least, most, take: int):
        self.ids, self.v, self.least, self.most, self.take = ids, v, least, most, take
        n, w = least.shape
        self.score = np.full((n, w, take), np.iinfo(np.int64).min)
        self.found = np.full((n, w, take), _LAST)
        self.none = np.ones((n, w, take), bool)
        up = v.astype(np.float64)
        self.plus, self.minus = np.maximum(up, 0), np.minimum(up, 0)
        self.skipped = self.read = 0

    def floor(self) -> np.ndarray:
        """What a row has to score at least to change a window."""
        return np.where(self.none[:, :, -1], self.least, np.maximum(self.least, self.score[:, :, -1]))

    def add(self, ids: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        up = self.plus @ high + self.minus @ low
        down = self.plus @ low + self.minus @ high
        slack = 0.5 + 1e-12 * np.maximum(np.abs(up), np.abs(down))
        open_ = (((up + slack)[:, None] >= self.floor()) & ((down - slack)[:, None] <= self.most)
                 & (self.least <= self.most)).any(1)
        self.skipped += int((~open_).sum())
        anchors = np.flatnonzero(open_)
        self.read += len(anchors)
        if not len(anchors):
            return
        by_id = np.argsort(ids, kind="stable")
        ids, v = ids[by_id], v[by_id]
        scores = _products(self.v[anchors], v)
        order = np.argsort(-scores, axis=1, kind="stable")  # ties stay in the order of ids
        ranked = np.take_along_axis(scores, order, 1)
        for k, a in enumerate(anchors.tolist()):
            falling = -ranked[k]
            floor = self.floor()[a]
            for w in range(self.least.shape[1]):
                if self.least[a, w] > self.most[a, w]:
                    continue
                begin = int(np.searchsorted(falling, -self.most[a, w], "left"))
                end = int(np.searchsorted(falling, -floor[w], "right"))
                if begin >= end:
                    continue
                part = order[k, begin:end]
                part = part[ids[part] != self.ids[a]][:self.take] if self.ids[a] != _LAST else part[:self.take]
                self._merge(a, w, scores[k, part], ids[part])

    def _merge(self, a: int, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old = ~self.none[a, w]
        scores = np.concatenate([self.score[a, w][old], scores])
        ids = np.concatenate([self.found[a, w][old], ids])
        best = np.lexsort((ids, -scores))[:self.take]
        n = len(best)
        self.score[a, w, :n], self.found[a, w, :n], self.none[a, w, :n] = scores[best], ids[best], False


def _search(batches: Iterator[pa.RecordBatch], schema: pa.Schema, take: int):
    """Input: a group and a block a row. Output: group, anchor, window, id, score of the best of some blocks."""
    held: OrderedDict[int, _Windows] = OrderedDict()

    def closed():
        grp, own = held.popitem(last=False)
        a, w, k = np.nonzero(~own.none)
        ids = own.found[a, w, k]
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(a), grp)), pa.array(a), pa.array(w), pa.array(ids, mask=ids == _LAST),
            pa.array(own.score[a, w, k])], schema=schema)

    names = ("grp", "dims", "n", "kind", "ids", "vectors", "least", "most",
             "b_n", "b_kind", "b_ids", "b_vectors", "b_low", "b_high")
    for batch in batches:
        columns = dict(zip(names, batch.columns))
        for i in range(len(batch)):
            get = lambda name: columns[name][i].as_py()  # noqa: B023, E731
            grp, dims = get("grp"), get("dims")
            if grp in held:
                held.move_to_end(grp)
            else:
                if len(held) == HELD:
                    yield closed()
                v = np.frombuffer(get("vectors"), get("kind")).reshape(get("n"), dims).astype(np.int64)
                windows = [np.array(get(x), np.int64).reshape(len(v), -1) for x in ("least", "most")]
                held[grp] = _Windows(_ids(get("ids")), v, *windows, take)
            block = np.frombuffer(get("b_vectors"), get("b_kind")).reshape(get("b_n"), dims)
            held[grp].add(_ids(get("b_ids")), block.astype(np.int64), np.array(get("b_low"), np.float64),
                          np.array(get("b_high"), np.float64))
    while held:
        yield closed()


def _ids(values: list) -> np.ndarray:
    """Null ids stand behind all others."""
    return np.array([_LAST if x is None else x for x in values], np.int64)


def best_of_windows(groups: DataFrame, blocks: DataFrame, same_label: bool, take: int) -> DataFrame:
    """``grp, a, w, id, score, rank`` (from 1): the first ``take`` rows of each window of each anchor.

    ``groups``: blocks of anchors named ``grp``, with arrays ``least`` and ``most`` of their windows, anchor by anchor.
    """
    widest = groups.select("grp", F.array_min("least").alias("least"), F.array_max("most").alias("most"))
    zones = written(_zones(groups, "grp").join(widest, "grp"), "zones")
    pairs = written(reached(zones, written(_zones(blocks, "area"), "zones"), same_label), "reached")
    left = groups.select("grp", "dims", "n", "kind", "ids", "vectors", "least", "most").join(pairs, "grp")
    right = blocks.select("area", "label", "block", *[F.col(c).alias(f"b_{c}") for c in ("n", "kind", "ids", "vectors", "low", "high")],
                          F.col("dims").alias("b_dims"))
    met = left.join(right, (left["area"] == right["area"]) & (left["label"] == right["label"])
                    & (left["dims"] == right["b_dims"]))
    met = met.select("grp", "dims", "n", "kind", "ids", "vectors", "least", "most", "b_n", "b_kind", "b_ids", "b_vectors",
                     "b_low", "b_high")
    found = map_rows(met, lambda b, arrow: _search(b, arrow, take),
                     T.StructType.fromDDL("grp long, a long, w long, id long, score long"))
    rank = F.row_number().over(Window.partitionBy("grp", "a", "w").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= take)


def _with_windows(groups: DataFrame, positives: DataFrame, n_positives: int, low: int, high: int) -> DataFrame:
    """``groups`` with the windows that the scores of their anchors' positives set."""
    scores = positives.groupBy("grp").agg(F.collect_list(F.struct("a", "rank", "score")).alias("scores"))
    joined = groups.drop("least", "most").join(scores, "grp")
    at, size = joined.columns.index("scores"), joined.columns.index("n")
    schema = T.StructType([*joined.drop("scores").schema.fields, *groups.select("least", "most").schema.fields])

    def run(batches, arrow):
        for batch in batches:
            both = []
            for n, own in zip(batch.column(size).to_pylist(), batch.column(at).to_pylist()):
                least, most = [1] * (n * n_positives), [0] * (n * n_positives)  # an empty window
                for s in own:
                    k = s["a"] * n_positives + s["rank"] - 1
                    least[k], most[k] = -(-low * s["score"] // 100), high * s["score"] // 100
                both.append((least, most))
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            windows = [pa.array([x[k] for x in both], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*rest, *windows], schema=arrow)

    return map_rows(joined, run, schema)


def mine(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY,
         n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT,
         block_rows: int = BLOCK_ROWS, area_rows: int = AREA_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components x become floor(256 x), scores are inner products. Anchors are the rows whose id is divisible by
    ``every``; an anchor's positives are its first ``n_positives`` rows of the same label, by score and then by
    smaller id. For each positive come the first ``n_negatives`` rows of other labels whose score is from ``low`` to
    ``high`` percent of the positive's.

    Rows with a null label or vector, or any null or non-finite component, take no part. Vectors are compared with
    those of their own length only. A row without an id is no anchor and stands behind all ids of its score. Repeated
    rows count each by itself, but a row is no partner of another with the same id. An empty table gives an empty
    result. Other columns are not read. Scores must stay below 2^62.
    """
    keyed = written(_keyed(usable_rows(df, vec_id, vector, label)), "hard-keys")
    own = keyed.filter(F.col("id") % every == 0)
    blocks = stored_blocks(keyed, keyed.count(), block_rows, area_rows, "hard-blocks")
    groups = stored_blocks(own, own.count(), group_rows, area_rows, "hard-anchors")
    groups = groups.withColumn("grp", F.shiftleft("area", 32) + F.col("block")).drop("area", "block")
    wide = groups.withColumns({k: F.array_repeat(F.lit(v), F.col("n").cast("int"))
                               for k, v in (("least", -_NO_LIMIT), ("most", _NO_LIMIT))})
    positives = written(best_of_windows(wide, blocks, True, n_positives).drop("w"), "hard-positives")
    windows = written(_with_windows(wide, positives, n_positives, low, high), "hard-windows")
    negatives = best_of_windows(windows, blocks, False, n_negatives)
    first = positives.select("grp", "a", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"),
                             F.col("score").alias("positive_score"))
    return (negatives.join(first, ["grp", "a", "w"]).join(groups.select("grp", F.col("ids").alias("own")), "grp")
            .select(F.get("own", F.col("a").cast("int")).alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
                    F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))

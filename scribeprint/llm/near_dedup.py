"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its ``SHINGLE``-word shingles. Two small collections of ``TABLES`` hashes each are
made for it; each hash joins ``ROWS`` minimums. A table key is a pair, one hash of either collection, so
2 * TABLES * ROWS minimums serve TABLES^2 tables of 2 * ROWS minimums a key. Two sets of similarity s
share a key unless they differ in a whole collection: with the values below that is missed with
probability 2 * (1 - 0.75^4)^28 = 5e-5 at s = 0.75, and 2e-7 at 0.8.

- Equal sets are one class from the start, whatever their number.
- Hashes that only one class has are dropped before any pair is formed.
- In a bucket, every class is compared with the one that shares most keys: as many comparisons as members,
  however hot the bucket is. Comparisons read the whole sets; links make components.
- Then only members of one bucket that are in different components are still open. They are compared
  as well: pair by pair in small buckets, and in larger ones by an exact set join that only brings texts
  together which share a rare shingle. So no link between candidates is lost, and a large group never becomes
  rows of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeprint.llm.components import components
from scribeprint.llm.scratch import as_text, free_name, importable, quoted, written
from scribeprint.llm.words import BLANKS, Words, mix, read_words, runs, sequence_hashes, whole_windows

SHINGLE = 5
ROWS, TABLES = 4, 28
#: Bits of a class id; above them, ids hold the order in which classes are centers of buckets.
ID_BITS = 52
#: Members of a bucket whose open pairs are rows; larger buckets are compared in blocks of so many texts and bytes.
SMALL_BUCKET = 12
BLOCK_TEXTS, BLOCK_BYTES = 256, 16 << 20
#: Least intersection of two linked sets, in percent of their union.
PERCENT = 75

_SEEDS = mix(np.arange(1, 2 * ROWS * 2 * TABLES + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_XOR = (_SEEDS[::2] >> np.uint64(32)).astype(np.uint32)
_FACTOR = (_SEEDS[1::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_TUPLE = mix(np.arange(1, 2 * TABLES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted in each, and where each row's begin (one more at the end)."""
    counts = words.counts
    shingles = sequence_hashes(words.hashes, size, 5)[whole_windows(words, size)]
    number = np.maximum(counts - size + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):  # the whole sequence is the one shingle
        own = np.array([sequence_hashes(words.hashes[words.first[r]:words.first[r + 1]], int(counts[r]),
                                        10 + int(counts[r]))[0] for r in short], np.uint64)
        begins = np.cumsum(number) - number
        shingles = np.insert(shingles, begins[short], own)
        number[short] = 1
    ends = np.cumsum(number)
    begins = ends - number
    for a, b in zip(begins.tolist(), ends.tolist()):
        shingles[a:b].sort()
    first = np.ones(len(shingles), bool)
    first[1:] = shingles[1:] != shingles[:-1]
    first[begins[number > 0]] = True
    return shingles[first], np.concatenate([[0], np.cumsum(first)])[np.concatenate([begins, ends[-1:]])]


def tuples(sets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The hashes of both collections for each set, [set, 2 * TABLES]; even ones are of the first. No set is empty."""
    low = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begins), 2 * TABLES), np.uint64)
    for t in range(2 * TABLES):
        joined = np.full(len(begins), _TUPLE[t], np.uint64)
        for k in range(t * ROWS, (t + 1) * ROWS):
            least = np.minimum.reduceat((low ^ _XOR[k]) * _FACTOR[k], begins)
            joined = mix(joined + least)
        out[:, t] = joined & ~np.uint64(1) | np.uint64(t % 2)
    return out


def set_digests(sets: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """128 bits of each set, whatever its order. No set is empty."""
    one = mix(np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), begins))
    two = mix(np.add.reduceat(mix(sets ^ np.uint64(0x14057B7EF767814F)), begins))
    return [a.tobytes() + b.tobytes() for a, b in zip(one, two)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: doc, text hash, text."""
    for batch in batches:
        number = np.zeros(batch.num_rows, np.int64)
        digest: list = [None] * batch.num_rows
        lists: list = [None] * batch.num_rows
        for words in read_words(batch.column(2), BLANKS, fold=True):
            sets, begins = shingle_sets(words)
            size = np.diff(begins)
            number[words.low:words.high] = size
            full = np.flatnonzero(size)
            if len(full):
                at = begins[:-1][full]
                for r, d, t in zip((full + words.low).tolist(), set_digests(sets, at), tuples(sets, at).view(np.int64)):
                    digest[r], lists[r] = d, t
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(number), pa.array(digest, pa.binary()),
             pa.array(lists, pa.list_(pa.int64()))], names=["doc", "text_hash", "n", "node", "tuples"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Input: a, b, text of a, text of b. The pairs that are linked."""
    for batch in batches:
        left, right = ([s for words in read_words(batch.column(k), BLANKS, fold=True)
                        for s in np.split(*_cut(words))] for k in (2, 3))
        good = []
        for x, y in zip(left, right):
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
            pa.array(good, pa.bool_()))


def _cut(words: Words) -> tuple[np.ndarray, np.ndarray]:
    sets, begins = shingle_sets(words)
    return sets, begins[1:-1]


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that are linked, told from their whole texts."""
    of = lambda side: texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}"))
    told = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b")
    return written(told.mapInArrow(lambda x: _linked(x, percent), "a long, b long"), "links")


def _keyed(classes: DataFrame) -> DataFrame:
    """``key, id``: the table keys of every class, from hashes that another class has too.

    The upper bits of these ids fall with the number of keys, so that the least id of a bucket is that of the
    class which shares most: the likely original of a group of copies.
    """
    hashes = classes.select("id", F.explode("tuples").alias("hash"))
    shared = hashes.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    # Written: of a join of two tables Spark splits a hot key, of one with sums it does not.
    shared = written(shared.filter("low < high").select("hash"), "shared-hashes")
    side = lambda n: F.collect_list(F.when(F.col("hash").bitwiseAND(1) == n, F.col("hash")))
    sides = hashes.join(shared, "hash").groupBy("id").agg(side(0).alias("left"), side(1).alias("right"))
    turn = F.lit(TABLES * TABLES) - F.size("left") * F.size("right")
    sides = sides.withColumn("id", F.shiftleft(turn.cast("long"), ID_BITS).bitwiseOR(F.col("id")))
    return sides.withColumn("left", F.explode("left")).withColumn("right", F.explode("right")).select(
        F.xxhash64("left", "right").alias("key"), "id")


def _class_id(id_: str) -> Column:
    return F.col(id_).bitwiseAND((1 << ID_BITS) - 1)


def _component_links(classes: DataFrame, keyed_texts: DataFrame, repeats: bool, percent: int) -> DataFrame:
    """``id, label`` of linked classes, in ids of classes. ``repeats``: whether rows of equal id and text occur."""
    keys = written(_keyed(classes), "table-keys")
    buckets = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("most"))
    buckets = written(buckets.filter("a < most").select("key", "a"), "buckets")
    members = written(keys.join(buckets, "key"), "members")
    pairs = written(members.filter("id <> a").select("a", F.col("id").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = wanted.select(F.col("id").alias("link_id"), _class_id("id").alias("id"))
    reps = classes.select("id", "n", F.col("rep.doc").alias("d_"), F.col("rep.text_hash").alias("h_")).join(wanted, "id")
    texts = keyed_texts.join(
        reps, keyed_texts["doc"].eqNullSafe(reps["d_"]) & (keyed_texts["text_hash"] == reps["h_"])).select(
        F.col("link_id").alias("id"), "n", "text")
    # One row for each class. Only repeated rows make more, and only then texts are moved once more.
    texts = written(texts.dropDuplicates(["id"]) if repeats else texts, "texts")
    links = _links(pairs, texts, percent)
    labels = components(links)
    more = _open_links(members, pairs, texts, labels, percent)
    if more is not None and not more.isEmpty():
        labels = components(links.unionAll(more))
    return labels.select(_class_id("id").alias("id"), _class_id("label").alias("label"))


def _open_links(members: DataFrame, pairs: DataFrame, texts: DataFrame, labels: DataFrame,
                percent: int) -> DataFrame | None:
    """Links between members of one bucket that are in different components.

    In small buckets these are pairs; the members of larger ones are joined as sets.
    """
    told = members.join(labels, "id", "left").select("key", "id", "a", F.coalesce("label", "id").alias("label"))
    told = written(told, "labelled")
    open_ = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                    F.count(F.lit(1)).alias("size")).filter("low < high").select("key", "size")
    part = written(told.join(written(open_, "open-buckets"), "key"), "open-members")
    if part.isEmpty():
        return None
    small = part.filter(F.col("size") <= SMALL_BUCKET).select("key", "id", "label")
    other = small.select("key", F.col("id").alias("id_"), F.col("label").alias("label_"))
    rest = small.join(other, "key").filter("label < label_").select(
        F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()
    found = _links(rest.join(pairs, ["a", "b"], "left_anti"), texts, percent)
    large = part.filter(F.col("size") > SMALL_BUCKET).select("id", "label").distinct()
    return found.unionAll(_links_of_many(written(large, "open-ids"), pairs, labels, texts, percent))


def _links_of_many(open_ids: DataFrame, pairs: DataFrame, labels: DataFrame, texts: DataFrame,
                   percent: int) -> DataFrame:
    """Links between texts of different components (``id, label``), by the exact size and prefix filters of a set join.

    Shingles are put in one order, those of few texts first. Two linked sets share one of the first shingles of either:
    with s percent, one of the first n - ceil(2 s n / (100 + s)) + 1 of the smaller set and of the first
    n - ceil(s n / 100) + 1 of the larger. Pages of one template differ in rare shingles, so those that are not
    linked seldom meet; only the shingles that more than one text has are moved. Sets that do meet are pairs,
    or are compared in blocks where very many meet in one shingle.
    """
    sets = written(texts.join(open_ids, "id").select("id", "label", "text").mapInArrow(
        _shingles, "id long, label long, shingles array<bigint>"), "open-sets")
    rows = sets.select("id", F.explode("shingles").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    ranked = rows.join(written(shared, "shared-shingles"), "shingle").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("texts", "shingle"))).alias("common"))
    n = F.size("shingles")
    first = lambda a, b: n - F.ceil(F.lit(a) * n / F.lit(b)).cast("int") + 1
    # Shingles of one text come first in the order and meet nothing.
    alone = n - F.size("common")
    short, long_ = first(2 * percent, 100 + percent), first(percent, 100)
    kept = F.slice("common", 1, F.greatest(long_ - alone, F.lit(0)))
    heads = sets.join(ranked, "id").select("id", "label", n.alias("n"), (short - alone).alias("short"),
                                           F.posexplode(kept).alias("at", "c"))
    heads = written(heads.select("id", "label", "n", (F.col("at") < F.col("short")).alias("small"),
                                 F.col("c.shingle").alias("shingle")), "heads")
    meet = heads.groupBy("shingle").agg(
        F.count_if("small").alias("small_"), F.count(F.lit(1)).alias("all_"), F.min("label").alias("low"),
        F.max("label").alias("high")).filter("small_ > 0 AND low < high")
    meet = written(meet.select("shingle", (F.col("small_") * F.col("all_")).alias("work")), "meetings")
    few = F.col("work") <= SMALL_BUCKET * SMALL_BUCKET
    own = heads.join(meet.filter(few), "shingle")
    other = own.select("shingle", F.col("id").alias("id_"), F.col("label").alias("label_"), F.col("n").alias("n_"))
    fits = ((F.col("n") < F.col("n_")) | ((F.col("n") == F.col("n_")) & (F.col("id") != F.col("id_")))) & (
        100 * F.col("n") >= percent * F.col("n_"))
    met = own.filter("small").join(other, "shingle").filter(fits & (F.col("label") != F.col("label_"))).select(
        F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()
    found = _links(met.join(pairs, ["a", "b"], "left_anti"), texts, percent)
    # Crowds that overlap are one group, so that a text is in one only.
    crowd = written(heads.join(meet.filter(~few), "shingle").select("id", "shingle"), "crowds")
    first_of = written(crowd.groupBy("shingle").agg(F.min("id").alias("a")), "crowd-centers")
    groups = components(crowd.join(first_of, "shingle").select("a", F.col("id").alias("b")))
    return found if groups.isEmpty() else found.unionAll(_block_links(groups, labels, texts, percent))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: id, label, text."""
    for batch in batches:
        sets = [s.view(np.int64) for words in read_words(batch.column(2), BLANKS, fold=True) for s in np.split(*_cut(words))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.list_(pa.int64()))],
                                         names=["id", "label", "shingles"])


def _block_links(groups: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links of different components in each group (``id, label``), compared block against block."""
    own = labels.select(F.col("id").alias("id_"), F.col("label").alias("component"))
    rows = groups.select("id", F.col("label").alias("group")).join(texts, "id")
    rows = rows.join(own, F.col("id") == F.col("id_"), "left").select(
        "group", "id", F.coalesce("component", "id").alias("component"), "text")
    sizes = rows.groupBy("group").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).alias("n_blocks"))
    rows = rows.join(written(sizes, "group-sizes"), "group")
    # A text goes to every pair of blocks that its own block is part of.
    block = F.pmod(F.xxhash64("id"), F.col("n_blocks"))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.select("group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                       "block", "id", "component", "text")
    return written(rows.groupBy("group", "low", "high").applyInArrow(
        lambda table: _compare_blocks(table, percent), "a long, b long"), "block-links")


def _compare_blocks(table: pa.Table, percent: int) -> pa.Table:
    """Links between the texts of two blocks, or of one with itself, that are in different components.

    The shingles of the right block are one sorted list; each text of the left one looks its own up in it.
    """
    block, high = table["block"].to_numpy(), table["high"][0].as_py()
    sets = [s for words in read_words(table["text"].combine_chunks(), BLANKS, fold=True)
            for s in np.split(*_cut(words))]
    sizes = np.array([len(s) for s in sets])
    component, ids = table["component"].to_numpy(), table["id"].to_numpy()
    right = np.flatnonzero(block == high)
    left = right if table["low"][0].as_py() == high else np.flatnonzero(block != high)
    shingles = np.concatenate([sets[k] for k in right]) if len(right) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    a, b = [], []
    for k in left:
        low, high_ = np.searchsorted(shingles, sets[k], "left"), np.searchsorted(shingles, sets[k], "right")
        both = np.bincount(owner[runs(low, high_ - low)], minlength=len(right))
        linked = (100 * both >= percent * (sizes[k] + sizes[right] - both)) & (component[right] != component[k])
        b.append(ids[right[linked]])
        a.append(np.full(int(linked.sum()), ids[k]))
    empty = np.empty(0, np.int64)
    return pa.table({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})


def _keyed_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(as_text(text)).alias("text_hash"),
                       as_text(text).alias("text"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_hash, n_shingles, class, component, component_id, kept``: one row a document.

    ``class`` is a digest of the shingle set, ``component`` numbers linked classes, ``component_id`` is the
    smallest id in the component and ``kept`` whether it is the document's own.

    Null and empty texts, and texts without words, have no shingles, no class and no component but their own; they are kept.
    Fewer than ``SHINGLE`` words are one shingle. Rows of equal id are documents of their own, linked
    by their texts only; those with the component's smallest id are all ``kept``. A null id is never the
    smallest, unless its component has no other. Texts are read whole; an empty table stays empty.
    """
    importable(docs.sparkSession)
    keyed = _keyed_documents(docs, doc_id, text)
    sketched = written(keyed.mapInArrow(
        _sketch, "doc long, text_hash long, n long, node binary, tuples array<bigint>"), "sketches")
    classes = sketched.filter("n > 0").groupBy("node").agg(
        F.min(F.struct("text_hash", "doc")).alias("rep"), F.min("doc").alias("least"),
        F.first("n").alias("n"), F.first("tuples").alias("tuples"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = sketched.filter("n > 0").groupBy("doc", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    repeats = not rows.filter("rows > 1").isEmpty()
    labels = _component_links(classes, keyed, repeats, percent)
    of_class = written(classes.select("id", "node", "least").join(labels, "id", "left").select(
        "node", "least", F.coalesce("label", "id").alias("component")), "class-components")
    least = written(of_class.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    told = of_class.join(least, "component").select(F.col("node").alias("node_"), "component", "component_id")
    joined = sketched.drop("tuples").join(told, sketched["node"] == told["node_"], "left")
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    return joined.select(
        F.col("doc").alias("doc_id"), "text_hash", F.col("n").alias("n_shingles"), F.col("node").alias("class"),
        "component", component_id.alias("component_id"),
        F.col("doc").eqNullSafe(component_id).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, that with its smallest id, and its own columns.

    Documents without words all stay. Of rows with equal id and text one stays.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    # A null id comes last; of equal ids the smallest text hash decides.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"))
    best = found.filter("n_shingles > 0").groupBy("component").agg(F.min(order).alias("best")).select("best.*")
    empty = found.filter("n_shingles = 0").select(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).distinct()
    none, id_, hash_ = names = [free_name(docs, n) for n in ("none_", "id_", "hash_")]
    keep = best.unionByName(empty).select(
        F.col("none").alias(none), F.coalesce("id_", F.lit(0)).alias(id_), F.col("hash_").alias(hash_))
    own = F.col(doc_id).cast("long")
    keyed = docs.select(*quoted(docs), own.isNull().alias(none), F.coalesce(own, F.lit(0)).alias(id_),
                        F.xxhash64(as_text(text)).alias(hash_))
    # Same columns for join and duplicates, so that rows are shuffled once.
    return keyed.join(keep, names, "left_semi").dropDuplicates(names).select(*quoted(docs))

"""Mixing sources to target weights with a low-discrepancy schedule of blocks.

1. Sizes of sources are added up, and targets follow by water filling.
2. Each source's documents are shuffled by a hash and laid end to end: a stream of words, cut
   into blocks of equally many words.
3. Every source needs so many slots for its target. Slot ``i`` of ``2^m`` has the van der Corput point
   ``i`` with its bits reversed; the sources' needs, added up, divide the points among
   them, so that every stretch of the schedule holds the sources in near their final shares.
   The rank of a slot among its source's slots has a closed form, without any sort.
4. Slot number ``r`` of a source takes block ``r`` of its stream, going round at the end.

Only DataFrame expressions are used. Rows of text never move: what is shuffled is id, size and
place. A hot source is cut into hash buckets; running sums go over buckets first, then inside each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribeprint.llm.scratch import written

#: Words of a block.
BLOCK_WORDS = 1024
#: Sources' weights in the order of their names, from the start again at the end.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a share of all, and the most times a source may be repeated.
SHARE = 1.5
REPEATS = 2
#: Buckets that a source's documents fall in by hash: one for so many documents.
BUCKET_DOCS = 4096
#: Points of the schedule in one row before they are dealt out.
STRETCH = 1 << 10
#: Blanks between words.
BLANKS = " \t\n\x0b\x0c\r"


def count_words(text: Column) -> Column:
    """Number of runs of what is not blank; null has none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit(0)).otherwise(
        F.size(F.split(trimmed, "[ \\t-\\r]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   repeats: int = REPEATS) -> DataFrame:
    """``source, source_size`` with ``target``, ``n_docs`` kept.

    Targets follow the weights, but none is above ``repeats`` times its source: sources are
    filled in the order of limit by weight, and what a full one leaves goes to the rest by weight.
    One row a source, so windows over all rows here hold sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(repeats))
    ranked = sizes.withColumn("weight", weight).withColumn("limit_", limit)
    fill = Window.orderBy(F.col("limit_") / F.col("weight"), F.col("source").asc_nulls_first())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(whole) * F.lit(float(share))
              - F.coalesce(F.sum("limit_").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    levelled = ranked.withColumn("level", level)
    # Levels fall from the first source that its level does not fill, which sets the level of all after it.
    open_ = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit_"), F.col("level"))).over(whole)
    final = levelled.withColumn("open", open_)
    target = F.coalesce(F.least("limit_", F.col("open") * F.col("weight")), F.col("limit_"))
    return final.select("source", "source_size", "n_docs", target.alias("target"))


def reversed_bits(i: Column, bits: Column) -> Column:
    """The ``bits`` low bits of ``i`` in reverse order."""
    text = F.reverse(F.lpad(F.bin(i), 63, "0"))
    return F.conv(F.substring(text, F.lit(1), bits), 2, 10).cast("long")


def points_below(slot: Column, point: Column, bits: Column, limit: Column) -> Column:
    """How many of the slots before ``slot``, whose own point is ``point``, have a point below ``limit``.

    The earlier slots fall into aligned runs, one for each set bit k of ``slot``. The points of a run of
    2^k slots are evenly spaced, 2^(bits-k) apart, and the first of them has the low bits of ``point``.
    """
    def add(total: Column, k: Column) -> Column:
        gap = _left(1, bits - k)
        first = point.bitwiseAND(_left(1, bits - k - 1) - 1)
        below = F.call_function("shiftright", limit - first + gap - 1, bits - k)
        own = F.least(F.greatest(below, F.lit(0).cast("long")), _left(1, k))
        return total + F.when(F.call_function("shiftright", slot, k).bitwiseAND(1) == 1, own).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), bits - 1), F.lit(0).cast("long"), add)


def _left(number: int, bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(number).cast("long"), bits)


def schedule(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``slot, source, rank, block_no, words``: which block each slot holds, and how many words of it.

    Takes the whole schedule on as many tasks as Spark likes: a slot needs
    nothing but its own number and the table of sources.
    """
    size, want = F.col("source_size"), F.round("target").cast("long")
    per_round = F.ceil(size / block).cast("long")
    rest = want - F.floor(want / size).cast("long") * size
    slots = F.when(size > 0, F.floor(want / size).cast("long") * per_round
                   + F.ceil(rest / block).cast("long")).otherwise(0)
    needs = (targets.withColumn("want", want).withColumn("blocks", per_round).withColumn("slots", slots)
             .filter("slots > 0"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    needs = needs.withColumn("upto", F.sum("slots").over(order)).withColumn("from", F.col("upto") - F.col("slots"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.max("upto").over(whole)
    needs = needs.withColumn("bits", F.length(F.bin(total - 1)))
    # A source's own slots are those whose points fall in its part; going through its points instead of
    # all slots gives the same pairs without a range join.
    # Stretches of points are dealt out to tasks; a task has about sixteen.
    n_slots = needs.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    parts = needs.select("*", F.explode(F.sequence(
        F.col("from"), F.col("upto") - 1, F.lit(STRETCH).cast("long"))).alias("begin"))
    points = parts.repartition(1 + n_slots // (16 * STRETCH), "source", "begin").select("*", F.explode(F.sequence(
        F.col("begin"), F.least(F.col("begin") + STRETCH, F.col("upto")) - 1)).alias("point"))
    placed = points.withColumn("slot", reversed_bits(F.col("point"), F.col("bits")))
    at = F.col("slot"), F.col("point"), F.col("bits")
    rank = points_below(*at, F.col("upto")) - points_below(*at, F.col("from"))
    ranked = placed.withColumn("rank", rank)
    turn, number = F.floor(F.col("rank") / F.col("blocks")).cast("long"), F.col("rank") % F.col("blocks")
    whole_words = F.least(F.lit(block).cast("long"), size - F.col("block_no") * block)
    before = turn * size + F.col("block_no") * block
    return (ranked.withColumn("block_no", number)
            .select("slot", "source", "rank", "block_no",
                    F.least(whole_words, F.col("want") - before).alias("words")))


def streams(told: DataFrame, seed: int) -> DataFrame:
    """Documents with words, with their ``offset`` in their source's stream."""
    told = told.filter("size > 0")
    hashed = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    n_buckets = F.ceil(F.col("n_docs") / F.lit(BUCKET_DOCS)).cast("long")
    told = told.withColumn("hash_", hashed).withColumn("bucket", F.pmod("hash_", n_buckets))
    sums = told.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_from", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    sums = sums.select(F.col("source").alias("s_"), F.col("bucket").alias("b_"), "bucket_from")
    inside = (Window.partitionBy("source", "bucket").orderBy("hash_", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = told.join(sums, told["source"].eqNullSafe(sums["s_"]) & (told["bucket"] == sums["b_"]))
    return placed.withColumn(
        "offset", F.col("bucket_from") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop(
        "s_", "b_", "bucket_from", "bucket", "hash_", "n_docs")


def _cut(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[float, ...], share: float,
         repeats: int, block: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents with their source's numbers; their parts by block; the schedule."""
    sized = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                count_words(F.col(text)).alias("size")), "mixing-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = written(source_targets(totals, weights, share, repeats), "mixing-targets")
    told = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    parts = streams(told, seed).withColumn("block_no", F.explode(F.sequence(
        F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))))
    # Written, so that the join knows the schedule's size: it grows with the input.
    slots = written(schedule(targets, block).select(
        "slot", F.col("source").alias("s_"), F.col("block_no").alias("b_"), "words"), "mixing-slots")
    return told, parts, slots


def _join(parts: DataFrame, slots: DataFrame, block: int, how: str) -> DataFrame:
    joined = parts.join(slots, parts["source"].eqNullSafe(slots["s_"]) & (parts["block_no"] == slots["b_"]), how)
    begin = F.col("block_no") * block
    last = F.least(begin + F.col("words"), F.col("offset") + F.col("size")) - F.col("offset")
    return (joined.withColumn("first_word", F.greatest(begin, F.col("offset")) - F.col("offset"))
            .withColumn("last_word", F.when(F.col("words").isNotNull(), last)))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
        block: int = BLOCK_WORDS, seed: int = 1) -> DataFrame:
    """The mix: ``slot, source, doc_id, offset, size, source_size, target, first_word, last_word``.

    A row is the words [first_word, last_word) of a document that a slot takes; in order of slot, then
    offset, the rows are the mixed stream.

    Weights go to sources by code point, null last; a null source is a source like others. Each source's
    words in the mix are its target, rounded. Null or empty texts have size 0 and are never taken. Equal
    ids and repeated rows are documents of their own, as their places in the stream differ; of
    documents with equal id, source and size it does not matter which goes first. Null ids are allowed.
    An empty table gives an empty result. Order and shuffle depend on ids and seed only; other columns of
    ``docs`` are not read.
    """
    _, parts, slots = _cut(docs, doc_id, text, source, weights, share, repeats, block, seed)
    return _join(parts, slots, block, "inner").filter("last_word > first_word").select(
        "slot", "source", "doc_id", "offset", "size", "source_size", "target", "first_word", "last_word")


def taken_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
                block: int = BLOCK_WORDS, seed: int = 1) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: the words of each document in ``mix``.

    One row a document; documents without words and those that no slot takes have ``taken`` 0.
    """
    told, parts, slots = _cut(docs, doc_id, text, source, weights, share, repeats, block, seed)
    columns = ["doc_id", "source", "size", "source_size", "target"]
    words = F.greatest(F.col("last_word") - F.col("first_word"), F.lit(0).cast("long"))
    got = _join(parts, slots, block, "left").groupBy(*columns, "offset").agg(
        F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"))
    empty = told.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return got.drop("offset").unionByName(empty)

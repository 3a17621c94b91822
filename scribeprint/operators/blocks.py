"""Trees and structural features of texts of any length, worked out block by block.

``operators.trees`` puts a sample into one window. That is right for files of source code, and wrong for a text of
hundreds of megabytes: its tokens would be one array and one sort. Here a text is cut into blocks of whole tokens,
blocks are dealt out, and no window or array ever holds more than a block, or one small row for each block of a text.

**Nesting.** Inside a block every bracket is matched that can be. What is left is a run of closes followed by a run
of opens, so a block is summed up as ``(closes, opens, nodes, bytes)``. The level at the start of a block follows from
running sums over those rows: with T the sum of opens less closes, it is T less the lowest point that T (taken after
a block's closes) has reached below 0. The j-th open close of a block that starts at level L ends the node at level
L - j + 1, or nothing if there is none. Of one level a block holds at most one open close and one open open, so
nodes that go over blocks are matched in windows of (text, level) with at most three rows a block, which also add
up their children: those behind the open in its block, those in blocks in between, those before the close.

**Features.** Counts of names, characters and tokens add up over blocks, as blocks end between words. The greatest
depth is the greatest of (level at the start of a block + greatest level in it); nested branches and loops are
counted by their level in the block and judged once the level of its start is known.

Cutting looks at a text once from its start, in the task that holds its row; it is the only step that does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scribeprint.functions.structure import (FEATURES, IF_TOKENS, LOOP_TOKENS, NODE_GROUPS,
                                             with_structural_features)
from scribeprint.functions.text import substring_count, words
from scribeprint.functions.tokens import (CODE, MARKUP, ROOTS, TOKEN, by_language, code_tokens,
                                          markup_tokens)
from scribeprint.operators.lookup import lookup_join
from scribeprint.operators.nesting import block_nodes, placed_nodes
from scribeprint.operators.trees import unpacked
from scribeprint.schema import NODES
from scribeprint.session import importable, size_tasks, stored

#: Tokens that one match of the cutting pattern takes, and matches of a block.
PIECE_TOKENS, BLOCK_PIECES = 128, 128
#: Bytes of a text whose blocks are worked on where it is; those of longer ones are dealt out.
NEAR_BYTES = 1 << 20
#: What a block knows by itself (``nesting.block_nodes``).
_LOCAL = """own_nodes bigint, own_bytes bigint, closes bigint, opens bigint, n_kept bigint, nodes binary, types array<string>,
    halves array<struct<seen:int,lows:int,height:int,n_children:int>>,
    ends array<struct<lows:int,seen:int,to_byte:int,n_children:int,is_rest:boolean>>"""
#: Characters of a block of words, at least; it ends at the next white space.
BLOCK_CHARS = 1 << 16
#: Bytes of text whose words a task counts, about.
TASK_BYTES = 1 << 24


def _pieces(code: Column, pattern: str, piece_tokens: int) -> Column:
    """The text in pieces of so many tokens. A token is atomic, so pieces end where tokens do."""
    return F.regexp_extract_all(code, F.lit(f"(?:(?>{pattern})){{1,{piece_tokens}}}+"), F.lit(0))


def _joined(pieces: Column, size: int) -> Column:
    """Stretches of ``size`` pieces as one string each."""
    starts = F.sequence(F.lit(1), F.size(pieces), F.lit(size))
    return F.when(F.size(pieces) > 0, F.transform(
        starts, lambda k: F.array_join(F.slice(pieces, k, size), "")))


def _dealt(texts: DataFrame, blocks: Column, *keep: str, tasks: int | None = None) -> DataFrame:
    """A row for each block; an empty text has one, without text. They are dealt to ``tasks`` partitions, if given."""
    rows = texts.select("sample_id", *keep, F.posexplode_outer(blocks).alias("block", "code"))
    return (rows.withColumns({"block": F.coalesce("block", F.lit(0)), "code": F.coalesce("code", F.lit(""))})
            .repartition(*([tasks] if tasks else []), "sample_id", "block"))


def _near(texts: DataFrame, pieces: Column, size: int, *keep: str) -> DataFrame:
    """As ``_dealt``, of stretches of ``size`` pieces, but a text of common length is not moved: its blocks are where it is."""
    is_long = F.octet_length("code") > NEAR_BYTES
    near = texts.select("sample_id", *keep, F.when(~is_long, pieces).alias("pieces"))
    # The outer form: Spark derives no filter from it that would cut every text a second time.
    blocks = F.when(F.col("pieces").isNotNull(), F.coalesce(_joined(F.col("pieces"), size), F.array(F.lit(""))))
    rows = near.select("sample_id", *keep, F.posexplode_outer(blocks).alias("block", "code")).filter(F.col("code").isNotNull())
    far = texts.filter(is_long).select("sample_id", *keep, pieces.alias("pieces"))
    return rows.unionByName(_dealt(far, _joined(F.col("pieces"), size), *keep))


def nodes_from_markup(pages: DataFrame, id_col: str = "sample_id", text: str = "code",
                      piece_tokens: int = PIECE_TOKENS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """As ``trees.nodes_from_markup``, for pages of any length."""
    texts = pages.filter(F.col(text).isNotNull()).select(
        F.col(id_col).alias("sample_id"), F.lit("document").alias("root"),
        _pieces(F.col(text), MARKUP, piece_tokens).alias("pieces"))
    dealt = _dealt(texts, _joined(F.col("pieces"), block_pieces), "root")
    return nodes_of_blocks(dealt.select("sample_id", "block", "root", markup_tokens(F.col("code")).alias("tokens")))


def nodes_from_code(samples: DataFrame, policy: str = "fail", languages: Sequence[str] = tuple(CODE),
                    piece_tokens: int = PIECE_TOKENS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """As ``trees.nodes_from_code``, for samples of any length."""
    return unpacked(packed_from_code(samples, policy, languages, piece_tokens, block_pieces))


def packed_from_code(samples: DataFrame, policy: str = "fail", languages: Sequence[str] = tuple(CODE),
                     piece_tokens: int = PIECE_TOKENS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``nodes_from_code`` with one row a block: ``sample_id`` and its ``nodes`` in preorder, as one array."""
    samples = samples.filter(F.col("code").isNotNull()).select("sample_id", "language", "code")
    if policy == "drop":
        samples = samples.filter(F.col("language").isin(*languages))
    of = lambda made, kind: by_language(F.col("language"), {n: made(n) for n in languages}, kind)
    texts = samples.select("sample_id", "language", "code", of(lambda n: F.lit(ROOTS[n]), "string").alias("root"))
    pieces = of(lambda n: _pieces(F.col("code"), CODE[n], piece_tokens), "array<string>")
    dealt = _near(texts, pieces, block_pieces, "language", "root")
    tokens = of(lambda n: code_tokens(F.col("code"), n), f"array<{TOKEN}>")
    return packed_nodes_of_blocks(dealt.select("sample_id", "block", "root", tokens.alias("tokens")))


def nodes_of_blocks(blocks: DataFrame) -> DataFrame:
    """Node table (``schema.NODES``) of ``sample_id, block, root, tokens``; blocks are numbered from 0."""
    return unpacked(packed_nodes_of_blocks(blocks))


def packed_nodes_of_blocks(blocks: DataFrame) -> DataFrame:
    """``nodes_of_blocks`` with one row a block: ``sample_id`` and its ``nodes`` in preorder, as one array.

    The rules are those of ``trees.nodes_from_tokens``: a close ends the innermost open node or is dropped, open nodes
    end with the text, and two texts of one id stop the job. Tokens of a block are worked on as one array; rows are
    made only of what goes over blocks. What blocks know by themselves is read several times, so it is stored in the
    shared folder when this is called; nodes are stored and moved as bytes, of which one takes one or two.
    """
    importable(blocks.sparkSession)
    known = T.StructType([*(blocks.schema[c] for c in ("sample_id", "block", "root")), *T.StructType.fromDDL(_LOCAL)])
    known_arrow = to_arrow_schema(known)
    local = stored(blocks.select("sample_id", "block", "root", "tokens").mapInArrow(
        lambda batches: block_nodes(batches, known_arrow), known), "block-nodes")
    starts = stored(_starts(local), "block-starts")
    late = _late(local, starts).groupBy("sample_id", "block").agg(
        F.collect_list(F.struct("pre", "below", "n_children", "end_byte")).alias("late"))
    # Blocks are looked up by rows that are much shorter, so they are moved once and not sorted.
    ready = lookup_join(starts.drop("root", "own_nodes", "own_bytes", "opens"), late, ["sample_id", "block"], "left")
    placed = lookup_join(local.select("sample_id", "block", "root", "nodes", "types", "n_kept"), ready.hint("shuffle_hash"),
                         ["sample_id", "block"])
    node = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in NODES.fields[2:])
    made = T.StructType([blocks.schema["sample_id"], T.StructField("nodes", T.ArrayType(T.StructType.fromDDL(node)))])
    made_arrow = to_arrow_schema(made)
    return placed.select("sample_id", "root", "level", "nodes_before", "bytes_before", "late", "nodes", "types", "n_kept").mapInArrow(
        lambda batches: placed_nodes(batches, made_arrow), made)


def _starts(local: DataFrame) -> DataFrame:
    """Per block: ``level`` (open nodes below the root), nodes and bytes before it, and its own; one row a block."""
    order = Window.partitionBy("sample_id").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    twice = F.raise_error(F.concat(F.lit("two texts have the id "), F.col("sample_id").cast("string")))
    again = F.lag("block").over(order) == F.col("block")
    net = F.coalesce(F.sum(F.col("opens") - F.col("closes")).over(before), F.lit(0))
    summary = (local.select("sample_id", "block", "root", "own_nodes", "own_bytes", "closes", "opens")
                    .withColumn("opens", F.when(again, twice.cast("bigint")).otherwise(F.col("opens")))
                    .withColumn("net", net).withColumn("low", F.col("net") - F.col("closes")))
    lowest = F.least(F.lit(0), F.coalesce(F.min("low").over(before), F.lit(0)))
    add = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return summary.select("sample_id", "block", "root", (F.col("net") - lowest).alias("level"), "own_nodes",
                          "own_bytes", add("own_nodes").alias("nodes_before"), add("own_bytes").alias("bytes_before"), "opens")


def _late(local: DataFrame, starts: DataFrame) -> DataFrame:
    """``sample_id, block, pre, below, n_children, end_byte`` of nodes that end in a later block than they begin in, or
    with the text, and of roots (in block 0)."""
    placed = lookup_join(local.select("sample_id", "block", "halves", "ends"), starts.hint("shuffle_hash"), ["sample_id", "block"])
    common = ("sample_id", "block", "level", "nodes_before", "bytes_before")
    half = placed.select(*common, F.explode("halves").alias("n")).select(*common, "n.*")
    ends = placed.select(*common, F.explode("ends").alias("e")).select(*common, "e.*")
    depth = F.greatest(F.col("level") - F.col("lows"), F.lit(0))
    top = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("block")))
    # Children of the root: those that its own blocks have found, and what crossed over them.
    totals = starts.withColumn("top", top).filter("top = 1").select(
        "sample_id", (F.col("nodes_before") + F.col("own_nodes")).alias("below"),
        (F.col("bytes_before") + F.col("own_bytes")).alias("end_byte"))
    kids = ends.filter(depth <= 0).groupBy("sample_id").agg(F.sum("n_children").alias("n_children"))
    zero = F.lit(0).cast("bigint")
    root = lookup_join(totals, kids, ["sample_id"], "left").select(
        "sample_id", F.lit(0).alias("block"), zero.alias("pre"), "below",
        F.coalesce("n_children", zero).alias("n_children"), "end_byte")
    over = _crossing(half.withColumn("depth", (depth + F.col("height") + 1).cast("bigint")),
                     ends.withColumn("depth", depth.cast("bigint")), starts)
    return over.unionByName(root)


def _crossing(half: DataFrame, ends: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes that end in a later block than they begin in, or with the text."""
    closes = ~F.col("is_rest") & (F.col("level") > F.col("lows"))
    seen = F.col("nodes_before") + F.col("seen")
    # A close ends the node at its level; the end of a block passes on; a close of nothing adds to the root.
    edges = ends.select("sample_id", "depth", "block", F.lit(0).alias("turn"), F.when(closes, F.struct(
        seen.alias("seen"), (F.col("bytes_before") + F.col("to_byte")).alias("to_byte"))).alias("close"),
        seen.alias("seen"), F.col("n_children").cast("bigint").alias("children"), F.lit(False).alias("is_open"))
    opens = half.select("sample_id", "depth", "block", F.lit(1).alias("turn"),
                        F.lit(None).cast("struct<seen:bigint,to_byte:bigint>").alias("close"), seen.alias("seen"),
                        F.col("n_children").cast("bigint").alias("children"), F.lit(True).alias("is_open"))
    rows = opens.unionByName(edges.filter(F.col("depth") > 0))
    order = Window.partitionBy("sample_id", "depth").orderBy("block", "turn")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (rows.withColumn("upto", F.sum("children").over(running))
                .withColumn("all", F.sum("children").over(Window.partitionBy("sample_id", "depth")))
                .withColumn("mark", F.when(F.col("close").isNotNull(), F.struct("close.seen", "close.to_byte", "upto")))
                .withColumn("end", F.expr("lead(mark) ignore nulls over (partition by sample_id, depth "
                                          "order by block, turn)"))
                .filter("is_open"))
    totals = starts.groupBy("sample_id").agg(F.sum("own_nodes").alias("all_nodes"), F.sum("own_bytes").alias("all_bytes"))
    rows = lookup_join(rows, totals, ["sample_id"])
    return rows.select(
        "sample_id", "block", F.col("seen").alias("pre"), (F.coalesce("end.seen", "all_nodes") - F.col("seen")).alias(
            "below"), (F.coalesce("end.upto", "all") - F.col("upto") + F.col("children")).alias("n_children"),
        F.coalesce("end.to_byte", "all_bytes").alias("end_byte"))


def structural_features(texts: DataFrame, text: str = "code", id_col: str = "sample_id",
                        block_chars: int = BLOCK_CHARS,
                        groups: Mapping[str, Sequence[str]] = NODE_GROUPS) -> DataFrame:
    """``sample_id`` and the features of ``structure.with_structural_features``, for texts of any length.

    Null texts have no row, and an id should stand for one text. Texts are measured when this is called, so that what a
    task gets, and sorts or counts, does not follow the size of the table.
    """
    rest = r"[^\s\x1c-\x1f]*+"
    cut = F.regexp_extract_all(F.col(text), F.lit(f"(?sU).{{1,{block_chars}}}+{rest}"), F.lit(0))
    tasks = size_tasks(texts, text, TASK_BYTES)
    dealt = _dealt(texts.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("sample_id"), text), cut, tasks=tasks)
    own = with_structural_features(dealt, "code", groups)
    names = [c for c in own.columns if c not in ("sample_id", "block", "code")]
    apart = ("max_depth", "branching", "nested_ifs", "nested_loops", "repetition")
    per_block = own.withColumns({
        "net": F.col("open_parens") - substring_count(F.col("code"), ")"),
        "n_words": F.size(words(F.col("code")))}).drop("code")
    order = Window.partitionBy("sample_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum("net").over(order), F.lit(0))
    summed = (per_block.withColumn("at", level + F.col("max_depth")).groupBy("sample_id")
              .agg(F.greatest(F.max("at"), F.lit(0)).cast("int").alias("max_depth"), F.sum("n_words").alias("n_words"),
                   *[F.sum(c).cast("int").alias(c) for c in names if c not in apart]))
    nested = _nested(dealt)
    distinct = (dealt.select("sample_id", F.explode(F.array_distinct(words(F.col("code")))).alias("word"))
                .repartition(tasks, "sample_id", "word").distinct()
                .groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_distinct")))
    joined = lookup_join(lookup_join(summed, nested, ["sample_id"], "left"), distinct, ["sample_id"], "left")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    made = {"branching": ratio("spaces", "open_parens"), "repetition": ratio("n_words", "n_distinct"),
            **{c: F.coalesce(c, F.lit(0)).cast("int") for c in ("nested_ifs", "nested_loops")}}
    return joined.select("sample_id", *[made.get(c, F.col(c)).alias(c) for c in [
        *FEATURES, *(n for n in names if n not in FEATURES)]])


def _nested(dealt: DataFrame) -> DataFrame:
    """Branch and loop tokens deeper than one level, without the first of each kind."""
    marks = dealt.select("sample_id", "block", F.posexplode(F.filter(
        words(F.col("code")), lambda t: t.isin("(", ")", *IF_TOKENS, *LOOP_TOKENS))).alias("pos", "t"))
    step = F.when(F.col("t") == "(", 1).when(F.col("t") == ")", -1).otherwise(0)
    reading = Window.partitionBy("sample_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("step", step).withColumn("height", F.sum("step").over(reading))
    kinds = {"ifs": F.col("t").isin(*IF_TOKENS), "loops": F.col("t").isin(*LOOP_TOKENS)}
    # By block and level inside of it: how many of each kind, and where the first one stands.
    counted = marks.groupBy("sample_id", "block", "height").agg(
        F.sum("step").alias("net"), *[F.count_if(k).alias(f"n_{n}") for n, k in kinds.items()],
        *[F.min(F.when(k, F.col("pos"))).alias(f"first_{n}") for n, k in kinds.items()])
    nets = counted.groupBy("sample_id", "block").agg(F.sum("net").alias("net"))
    order = Window.partitionBy("sample_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    levels = nets.select("sample_id", "block", F.coalesce(F.sum("net").over(order), F.lit(0)).alias("level"))
    placed = lookup_join(counted, levels, ["sample_id", "block"])
    deep = F.col("level") + F.col("height") > 1
    firsts = [F.min(F.when(F.col(f"first_{n}").isNotNull(), F.struct("block", f"first_{n}", deep.alias("deep"))))
              .alias(f"f_{n}") for n in kinds]
    added = placed.groupBy("sample_id").agg(
        *[F.sum(F.when(deep, F.col(f"n_{n}")).otherwise(0)).alias(n) for n in kinds], *firsts)
    return added.select("sample_id", *[
        (F.col(n) - F.coalesce(F.col(f"f_{n}.deep").cast("int"), F.lit(0))).alias(f"nested_{n}") for n in kinds])

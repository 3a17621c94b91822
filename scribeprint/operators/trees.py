"""Trees as node tables (``schema.NODES``): building, counting and serialising them.

A node is placed by its preorder and postorder ranks, so no step is recursive
and a tree may be as deep as it likes. With n nodes, the ranks give dense event
positions 0 .. 2n-1: a node opens at ``2 * pre - depth`` and closes at
``2 * post + depth + 1``; it has ``post - pre + depth`` nodes below it.

All steps group by ``sample_id``. A tree is one sample's text, which was one
cell of a row, so a group is never larger than that; a node table that is
already laid out by ``sample_id`` is not shuffled again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scribeprint.functions.tokens import (CODE, ROOTS, TEXT_TOKEN, TOKEN, by_language, code_tokens,
                                          markup_tokens, token)
from scribeprint.operators.nesting import node_stretches, packed_nodes, stretch_digests
from scribeprint.schema import NODES
from scribeprint.session import importable

# Inner nodes of these types are written as their text.
ATOMIC_TYPES = ("identifier", "string_literal", "number_literal")
#: Types that inner nodes of packed code have.
INNER_TYPES = {"parenthesized", "bracketed", "block", *ROOTS.values()}

_OPEN, _CLOSE, _LEAF = "open", "close", "leaf"


def nodes_from_markup(pages: DataFrame, id_col: str = "sample_id", text: str = "code") -> DataFrame:
    """Node table of the tags of HTML or XML, under a root of type ``document``."""
    texts = pages.filter(F.col(text).isNotNull()).select(
        F.col(id_col).alias("sample_id"), F.col(text).alias("code")).repartition("sample_id")
    return nodes_from_tokens(texts.select(
        "sample_id", F.lit("document").alias("root"), markup_tokens(F.col("code")).alias("tokens")))


def nodes_from_code(samples: DataFrame, policy: str = "fail",
                    languages: Sequence[str] = tuple(CODE), texts: bool = False) -> DataFrame:
    """Node table of the brackets of source code, tokenised by the rules of its language.

    ``samples`` has ``sample_id``, ``code`` and ``language``. An unsupported
    language stops the job (``fail``), or its rows are left out (``drop``). With ``texts`` there
    is a column ``text``: that of leaves, which is null for inner nodes.
    """
    return unpacked(packed_from_code(samples, policy, languages, texts))


def packed_from_code(samples: DataFrame, policy: str = "fail", languages: Sequence[str] = tuple(CODE),
                     texts: bool = False, tasks: int | None = None) -> DataFrame:
    """``nodes_from_code`` with one row a sample: ``sample_id`` and its ``nodes`` in preorder, as one array.

    Texts are dealt out by ``sample_id``, to ``tasks`` partitions if a number is given. Behind that a task holds the
    tokens of one slice of samples at a time: nothing is sorted or spilled but texts.
    """
    samples = samples.filter(F.col("code").isNotNull()).select("sample_id", "language", "code")
    if policy == "drop":
        samples = samples.filter(F.col("language").isin(*languages))
    samples = _single(samples.repartition(*([tasks] if tasks else []), "sample_id"))
    tokens = by_language(F.col("language"), {
        name: code_tokens(F.col("code"), name, texts) for name in languages},
        f"array<{TEXT_TOKEN if texts else TOKEN}>")
    root = by_language(F.col("language"), {n: F.lit(ROOTS[n]) for n in languages}, "string")
    whole = [F.col("code")] if texts else []
    tokenised = samples.select("sample_id", root.alias("root"), tokens.alias("tokens"), *whole)
    node = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in NODES.fields[2:])
    made = T.StructType([tokenised.schema["sample_id"], T.StructField("nodes", T.ArrayType(T.StructType.fromDDL(
        node + (", text: string" if texts else ""))))])
    arrow = to_arrow_schema(made)
    importable(samples.sparkSession)
    return tokenised.mapInArrow(lambda batches: packed_nodes(batches, arrow), made)


def _single(texts: DataFrame) -> DataFrame:
    """``texts``, laid out by ``sample_id``; two rows of one id stop the job."""
    twice = F.raise_error(F.concat(F.lit("two texts have the id "), F.col("sample_id").cast("string")))
    rows = F.count("*").over(Window.partitionBy("sample_id"))
    return texts.withColumn("__rows", rows).filter(
        F.when(F.col("__rows") > 1, twice.cast("boolean")).otherwise(F.lit(True))).drop("__rows")


def unpacked(packed: DataFrame) -> DataFrame:
    """The node table of samples with a ``nodes`` array."""
    fields = packed.schema["nodes"].dataType.elementType.names
    return packed.select("sample_id", F.explode("nodes").alias("n")).select(
        "sample_id", F.col("n.pre").alias("node_id"), *[F.col(f"n.{f}").alias(f) for f in fields])


def nodes_from_tokens(tokenised: DataFrame, texts: bool = False) -> DataFrame:
    """Node table of token arrays (``sample_id``, ``root``, ``tokens``; see functions.tokens).

    A close ends the innermost open node. A close with no open node is dropped,
    and nodes still open at the end of the text end there. Two token arrays of
    one ``sample_id`` stop the job.

    The input should be laid out by ``sample_id`` before it is tokenised: then texts are what is
    exchanged, and every window below keeps that layout. With ``texts`` tokens have a text, and there is a column
    ``code``, the text of a root without children.
    """
    # Levels still open at the end get a close of their own, so that every open has one.
    def walk(acc: Column, t: Column) -> Column:
        return F.greatest(acc + t["step"], F.lit(0))

    still_open = F.aggregate("tokens", F.lit(0), walk)
    none = F.lit(None).cast("string")
    lone = F.when(~F.exists("tokens", lambda t: t["is_node"]), F.col("code")) if texts else None
    root = token(0, True, F.col("root"), F.lit(0), lone)
    end = token(-1, False, none, F.lit(0), none if texts else None)
    whole = F.concat(F.array(root), F.col("tokens"), F.array_repeat(end, still_open + 1))
    rows = (tokenised.select("sample_id", whole.alias("tokens"))
                    .select("sample_id", F.size("tokens").alias("n"),
                            # the outer form: Spark derives no filter from it that would
                            # tokenise every text a second time
                            F.posexplode_outer("tokens").alias("pos", "t"))
                    .select("sample_id", "n", "pos", "t.*"))

    reading = Window.partitionBy("sample_id").orderBy("pos")
    so_far = reading.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = reading.rowsBetween(Window.unboundedPreceding, -1)
    is_root, is_last = F.col("pos") == 0, F.col("pos") == F.col("n") - 1
    twice = F.raise_error(F.concat(F.lit("two texts have the id "), F.col("sample_id").cast("string")))
    rows = (rows.withColumn("step", F.when(F.sum(is_root.cast("int")).over(so_far) > 1, twice.cast("int"))
                            .otherwise(F.col("step")))
                .withColumn("sum", F.sum("step").over(so_far))
                .withColumn("seen", F.sum(F.col("is_node").cast("int")).over(so_far))
                .withColumn("to_byte", F.sum("n_bytes").over(so_far))
                # The level never sinks below 0: take off what stray closes took from the sum.
                .withColumn("lost", F.least(F.lit(0), F.coalesce(F.min("sum").over(before),
                                                                 F.lit(0))))
                .withColumn("level", F.col("sum") - F.col("step") - F.col("lost")))

    # Level of the parent for leaves and opens (the row counts as a child there), and the
    # node's own level for opens and closes.
    own_text = ["text"] if texts else []
    common = [F.col(c) for c in ("pos", "type", "seen", "to_byte", "n_bytes", *own_text)]

    def at(level: Column, role: str, child: bool) -> Column:
        return F.struct(level.cast("int").alias("depth"), F.lit(role).alias("role"),
                        F.lit(child).alias("child"))

    level = F.col("level")
    roles = (F.when(is_root, F.array(at(F.lit(0), _OPEN, False)))
              .when(is_last, F.array(at(F.lit(0), _CLOSE, False)))
              .when(F.col("step") == 1,
                    F.array(at(level + 1, _OPEN, False), at(level, "inner", True)))
              .when((F.col("step") == -1) & (level > 0), F.array(at(level, _CLOSE, False)))
              .when(F.col("is_node"), F.array(at(level, _LEAF, True))))
    events = rows.select("sample_id", *common, F.explode(roles).alias("r")).select(
        "sample_id", *common, "r.*")

    siblings = Window.partitionBy("sample_id", "depth").orderBy("pos")
    running = siblings.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.when(~F.col("child"), F.struct("seen", "to_byte", "children"))
    nodes = (events.withColumn("children", F.sum(F.col("child").cast("int")).over(running))
                   .withColumn("edge", edge)
                   .withColumn("close", F.expr(
                       "lead(edge) ignore nulls over (partition by sample_id, depth order by pos)"))
                   .filter(F.col("role").isin(_OPEN, _LEAF)))
    leaf = F.col("role") == _LEAF
    pre = F.col("seen") - 1
    depth = F.when(leaf, F.col("depth") + 1).otherwise(F.col("depth"))
    below = F.when(leaf, F.lit(0)).otherwise(F.col("close.seen") - F.col("seen"))
    columns = {
        "node_id": pre, "pre": pre, "post": pre + below - depth, "depth": depth,
        "n_children": F.when(leaf, F.lit(0)).otherwise(F.col("close.children") - F.col("children")),
        "type": F.col("type"),
        "start_byte": F.col("to_byte") - F.col("n_bytes"),
        "end_byte": F.when(leaf, F.col("to_byte")).otherwise(F.col("close.to_byte")),
    }
    return nodes.select("sample_id", *[
        (c if name == "type" else c.cast("int")).alias(name) for name, c in columns.items()], *own_text)


def node_digest(nodes: DataFrame) -> DataFrame:
    """Per sample, the number of nodes and a SHA-256 of all of them in preorder, to compare node tables by.

    A node is written as its columns with colons between them (a null type as nothing), nodes with line feeds.
    Rows of a packed node table (``sample_id, nodes``) have a stretch of the preorder each; they are moved as bytes, and
    lines are written where all of a sample are, some at a time.
    """
    if "nodes" in nodes.columns:
        own = nodes.schema["sample_id"]
        moved = T.StructType([own, *T.StructType.fromDDL("pre bigint, n bigint, nodes binary, types array<string>")])
        made = T.StructType([own, *T.StructType.fromDDL("n_nodes bigint, nodes_sha256 string")])
        moved_arrow, arrow = to_arrow_schema(moved), to_arrow_schema(made)
        importable(nodes.sparkSession)
        stretches = nodes.select("sample_id", "nodes").mapInArrow(lambda batches: node_stretches(batches, moved_arrow), moved)
        laid_out = stretches.repartition("sample_id").sortWithinPartitions("sample_id", "pre").select(
            "sample_id", "pre", "n", "nodes", "types")
        return laid_out.mapInArrow(lambda batches: stretch_digests(batches, arrow), made)
    numbers = [F.col(c).cast("string") for c in ("node_id", "pre", "post", "depth", "n_children")]
    line = F.concat_ws(":", *numbers, F.coalesce("type", F.lit("")), F.col("start_byte").cast("string"),
                       F.col("end_byte").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("pre", line.alias("line"))))
    return nodes.groupBy("sample_id").agg(F.count("*").alias("n_nodes"), F.sha2(
        F.array_join(F.transform(listed, lambda x: x["line"]), "\n"), 256).alias("nodes_sha256"))


def node_types(nodes: DataFrame) -> DataFrame:
    """Per sample, the types of all nodes in preorder, repeats included."""
    listed = F.sort_array(F.collect_list(F.struct("pre", "type")))
    return nodes.groupBy("sample_id").agg(F.transform(listed, lambda x: x["type"]).alias("types"))


def _slice(code: Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(code, start + 1, end - start), "UTF-8")


def _bytes_of(samples: DataFrame) -> DataFrame:
    """The encoded text, made once per sample (below a join, so not once per node)."""
    return samples.select(F.col("sample_id").alias("__id"),
                          F.encode("code", "UTF-8").alias("__bytes"))


def node_text(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """The text of every node: the bytes from ``start_byte`` to ``end_byte`` (exclusive).

    Nodes are gathered to one row per sample before the join, so the text of a
    sample is moved and encoded once and not once per node. They are opened
    again before the bytes are cut, so the texts of all nodes are never held at once.
    """
    spans = nodes.groupBy("sample_id").agg(
        F.collect_list(F.struct("node_id", "start_byte", "end_byte")).alias("spans"))
    joined = spans.join(_bytes_of(samples), F.col("sample_id") == F.col("__id"))
    opened = joined.select("sample_id", "__bytes", F.explode_outer("spans").alias("s"))
    return opened.select("sample_id", "s.node_id", _slice(
        F.col("__bytes"), F.col("s.start_byte"), F.col("s.end_byte")).alias("text"))


def serialise_tree(nodes: DataFrame) -> DataFrame:
    """Per sample, the nested form: a leaf is its type, an inner node ``(type child child)``."""
    def events(n) -> Column:
        inner = n["n_children"] > 0
        gap = F.when(n["depth"] > 0, F.lit(" ")).otherwise(F.lit(""))
        head = F.concat(gap, F.when(inner, F.lit("(")).otherwise(F.lit("")), n["type"])
        opens = _event(2 * n["pre"] - n["depth"], head)
        return F.when(inner, F.array(opens, _event(2 * n["post"] + n["depth"] + 1, F.lit(")")))).otherwise(F.array(opens))

    if "nodes" in nodes.columns:
        listed = F.sort_array(F.flatten(F.transform("nodes", events)))
        return nodes.select("sample_id", F.array_join(F.transform(listed, lambda e: e["text"]), "").alias("tree"))
    columns = {c: F.col(c) for c in ("pre", "post", "depth", "n_children", "type")}
    return _joined(nodes.select("sample_id", F.explode(events(columns)).alias("e")), "")


def serialise_tokens(nodes: DataFrame, samples: DataFrame | None = None,
                     atomic_types: Sequence[str] = ATOMIC_TYPES) -> DataFrame:
    """Per sample, structure and text: ``type::left ... type::right`` with leaf texts between.

    A leaf, or a node of an atomic type, gives its text and hides what is below it. Texts are cut from the
    ``code`` of ``samples``; without it they are the nodes' own (``text``), so that no text is moved again. Then
    inner nodes of atomic types must have one.
    """
    none = F.lit(None)

    def events(n) -> Column:
        own = none.cast("string") if samples is not None else F.coalesce(n["text"], F.raise_error(F.concat(
            F.lit("a node without a text, of type "), n["type"])).cast("string"))
        opens, closes = 2 * n["pre"] - n["depth"], 2 * n["post"] + n["depth"] + 1
        span = [n["start_byte"].alias("start"), n["end_byte"].alias("end")]
        no_span = [none.cast("int").alias("start"), none.cast("int").alias("end")]
        return F.when(n["atomic"], F.array(
            F.struct(opens.alias("pos"), own.alias("mark"), *span))).otherwise(F.array(
                F.struct(opens.alias("pos"), F.concat(n["type"], F.lit("::left")).alias("mark"), *no_span),
                F.struct(closes.alias("pos"), F.concat(n["type"], F.lit("::right")).alias("mark"), *no_span)))

    if "nodes" in nodes.columns:
        if set(atomic_types) & INNER_TYPES:
            return serialise_tokens(unpacked(nodes), samples, atomic_types)
        # Only leaves are atomic, and nothing is below them.
        marked = F.transform("nodes", lambda n: n.withField("atomic", n["n_children"] == 0))
        listed = nodes.select("sample_id", F.sort_array(F.flatten(F.transform(marked, events))).alias("events"))
        return _written(listed, samples)
    reading = (Window.partitionBy("sample_id").orderBy("pre")
                     .rowsBetween(Window.unboundedPreceding, -1))
    atomic = (F.col("n_children") == 0) | F.col("type").isin(*atomic_types)
    last_below = F.col("post") + F.col("depth")
    covered = F.max(F.when(F.col("atomic"), F.col("last_below"))).over(reading)
    shown = (nodes.withColumn("atomic", atomic).withColumn("last_below", last_below)
                  .withColumn("covered", covered)
                  .filter(F.col("covered").isNull() | (F.col("pre") > F.col("covered"))))
    columns = {c: F.col(c) for c in ("pre", "post", "depth", "type", "start_byte", "end_byte", "atomic")}
    if samples is None:
        columns["text"] = F.col("text")
    listed = (shown.select("sample_id", F.explode(events(columns)).alias("e")).groupBy("sample_id")
                   .agg(F.sort_array(F.collect_list("e")).alias("events")))
    return _written(listed, samples)


def _written(listed: DataFrame, samples: DataFrame | None) -> DataFrame:
    """The trees of samples with an array of ``events``; those without a mark are cut from the text."""
    if samples is None:
        return listed.select("sample_id", F.array_join(F.transform("events", lambda e: e["mark"]), " ").alias("tree"))
    joined = listed.join(_bytes_of(samples), F.col("sample_id") == F.col("__id"))
    pieces = F.transform("events", lambda e: F.coalesce(
        e["mark"], _slice(F.col("__bytes"), e["start"], e["end"])))
    return joined.select("sample_id", F.array_join(pieces, " ").alias("tree"))


def _event(pos: Column, text: Column) -> Column:
    return F.struct(pos.alias("pos"), text.alias("text"))


def _joined(events: DataFrame, separator: str) -> DataFrame:
    listed = F.sort_array(F.collect_list("e"))
    text = F.array_join(F.transform(listed, lambda e: e["text"]), separator)
    return events.groupBy("sample_id").agg(text.alias("tree"))


def tree_stats(nodes: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Exact counts per sample: nodes, leaves, greatest depth, and nodes per group of types."""
    return nodes.groupBy("sample_id").agg(
        F.count("*").alias("n_nodes"),
        F.count_if(F.col("n_children") == 0).alias("n_leaves"),
        F.max("depth").alias("max_depth"),
        *[F.count_if(F.col("type").isin(*types)).alias(f"n_{name}")
          for name, types in groups.items()])


def represent(samples: DataFrame, include_tokens: bool = False, policy: str = "fail") -> DataFrame:
    """``sample_id`` and ``tree``: the serialised form of every sample's code."""
    packed = packed_from_code(samples, policy, texts=include_tokens)
    return serialise_tokens(packed) if include_tokens else serialise_tree(packed)

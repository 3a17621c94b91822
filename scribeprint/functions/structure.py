"""The 23 structural features of a serialised tree (or of any other text).

Every feature is a function of one string column. Counts are substring counts
on purpose: a name inside a longer one counts for both, and an inner node that
was written as ``type::left ... type::right`` counts twice. Exact node counts
per type come from ``operators.trees.tree_stats`` instead.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeprint.functions.text import (repetition_ratio, substring_count,
                                        words)

# Node names counted together, by feature.
NODE_GROUPS: dict[str, tuple[str, ...]] = {
    "control_flow": ("if_statement", "for_statement", "while_statement", "switch_statement",
                     "try_statement", "catch_clause", "except_clause", "finally_clause"),
    "functions": ("function_definition", "method_declaration", "method_invocation",
                  "call", "lambda", "constructor_declaration"),
    "classes": ("class_definition", "class_declaration", "interface_declaration",
                "field_declaration", "variable_declarator"),
    "assignments": ("assignment", "assignment_expression", "expression_statement",
                    "binary_expression", "unary_expression"),
    "imports": ("import_statement", "import_from_statement", "import_declaration"),
    "data_structures": ("list", "dictionary", "array_creation_expression", "array_access",
                        "list_comprehension", "dictionary_comprehension",
                        "set_comprehension"),
}
# Single names, by feature.
LITERAL_NAMES: dict[str, tuple[str, ...]] = {
    "identifiers": ("identifier",),
    "strings": ("string",),
    "integers": ("integer",),
    "floats": ("float",),
    "booleans": ("true", "false"),
}
STYLE_NAMES: dict[str, tuple[str, ...]] = {
    "comments": ("comment",),
    "passes": ("pass_statement",),
    "returns": ("return_statement",),
    "parameter_lists": ("parameter_list",),
}
# Whole tokens that mark a branch or a loop.
IF_TOKENS = ("if_statement", "elif_clause")
LOOP_TOKENS = ("for_statement", "while_statement")

FEATURES: tuple[str, ...] = (
    "max_depth", *NODE_GROUPS, "n_chars", "open_parens", "spaces", "branching",
    *LITERAL_NAMES, "nested_ifs", "nested_loops", *STYLE_NAMES, "repetition",
)


def max_nesting(s: Column) -> Column:
    """Deepest level of round brackets. The level may go below zero; the result may not."""
    brackets = F.split(F.regexp_replace(s, "[^()]+", ""), "")
    step = lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
    return F.aggregate(
        brackets,
        F.struct(F.lit(0).alias("level"), F.lit(0).alias("top")),
        lambda acc, c: F.struct(
            (acc["level"] + step(c)).alias("level"),
            F.greatest(acc["top"], acc["level"] + step(c)).alias("top")),
        lambda acc: acc["top"])


def nested_control(tokens: Column, if_tokens: Sequence[str] = IF_TOKENS,
                   loop_tokens: Sequence[str] = LOOP_TOKENS) -> Column:
    """``struct(ifs, loops)``: branch and loop tokens that stand deeper than one level,
    not counting the first of each kind (whatever its own level)."""
    marks = F.filter(tokens, lambda t: t.isin("(", ")", *if_tokens, *loop_tokens))
    kinds = {"ifs": if_tokens, "loops": loop_tokens}

    def step(acc: Column, t: Column) -> Column:
        deep = (acc["level"] > 1).cast("int")
        up = F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        hit = {k: t.isin(*names) for k, names in kinds.items()}
        return F.struct(
            (acc["level"] + up).alias("level"),
            *[(acc[k] + F.when(hit[k], deep).otherwise(0)).alias(k) for k in kinds],
            *[F.coalesce(acc[f"first_{k}"], F.when(hit[k], deep)).alias(f"first_{k}") for k in kinds])

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("level"), *[F.lit(0).alias(k) for k in kinds],
                     *[none.alias(f"first_{k}") for k in kinds])
    # All deep hits, less the first hit of the kind if that one is deep.
    return F.aggregate(marks, start, step, lambda acc: F.struct(*[
        (acc[k] - F.coalesce(acc[f"first_{k}"], F.lit(0))).alias(k) for k in kinds]))


def with_structural_features(df: DataFrame, text: str = "code",
                             groups: Mapping[str, Sequence[str]] = NODE_GROUPS) -> DataFrame:
    """``df`` plus the 23 feature columns, in the order of ``FEATURES``.

    One narrow pass: no shuffle, and the text is split into words once. Names with
    an underscore are counted in the words that have one: a name without white
    space lies inside one word, so the number is that of the whole text, and the
    text to search is much shorter. ``groups`` may replace the names that are
    counted together; a name may not contain white space.
    """
    named = {**groups, **LITERAL_NAMES, **STYLE_NAMES}
    if any(re.search(r"\s", n) for names in named.values() for n in names):
        raise ValueError("a counted name may not contain white space")
    s, tokens = F.col(text), F.col("__words")

    def occurrences(names: Sequence[str]) -> Column:
        return sum((substring_count(F.col("__snake") if "_" in n else s, n) for n in names),
                   F.lit(0))

    opens, spaces = substring_count(s, "("), substring_count(s, " ")
    columns: dict[str, Column] = {
        "max_depth": max_nesting(s),
        "n_chars": F.length(s),
        "open_parens": F.col("__opens"),
        "spaces": F.col("__spaces"),
        "branching": F.coalesce(F.try_divide(F.col("__spaces").cast("double"), F.col("__opens")),
                                F.lit(0.0)),
        "nested_ifs": F.col("__nested.ifs"),
        "nested_loops": F.col("__nested.loops"),
        "repetition": repetition_ratio(tokens),
        **{name: occurrences(names) for name, names in named.items()},
    }
    order = [*FEATURES, *(name for name in groups if name not in FEATURES)]
    helpers = df.withColumn("__words", words(s)).withColumns({
        "__snake": F.array_join(F.filter(tokens, lambda w: w.contains("_")), " "),
        "__nested": nested_control(tokens),
        "__opens": opens,
        "__spaces": spaces,
    })
    return helpers.select(*[F.col(c) for c in df.columns],
                          *[columns[name].alias(name) for name in order if name in columns])


def feature_array(names: Sequence[str] = FEATURES) -> Column:
    """The feature columns as one ``array<float>``, in fixed order."""
    return F.array(*[F.col(n).cast("float") for n in names])

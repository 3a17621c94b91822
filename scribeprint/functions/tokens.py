"""Tokens of markup and of source code, as arrays of structs that cover the whole text.

A token is ``struct(step, is_node, type, n_bytes)``: ``step`` is 1 where a node
opens, -1 where one closes, 0 for a leaf. Concatenated, the tokens are the text,
so running sums of ``n_bytes`` are byte offsets.
"""

from __future__ import annotations

import keyword
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "struct<step:int,is_node:boolean,type:string,n_bytes:int>"
#: The same with the token's own text, for leaves.
TEXT_TOKEN = TOKEN[:-1] + ",text:string>"

MARKUP = r"(?s)<!--.*?-->|<[^>]*>|[^<]+|<"
# HTML elements that have no end tag.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "param", "source", "track", "wbr")

_NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
_REST = rf"|\p{{N}}[\p{{L}}\p{{N}}_.]*|{_NAME}|\s+|."
_QUOTED = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|' + r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
CODE: dict[str, str] = {
    "python": r'(?s)#[^\n]*|""".*?"""|' + r"'''.*?'''|" + _QUOTED + _REST,
    "java": r"(?s)//[^\n]*|/\*.*?\*/|" + _QUOTED + _REST,
}
KEYWORDS: dict[str, tuple[str, ...]] = {
    "python": tuple(keyword.kwlist),
    # Reserved words of the language.
    "java": ("abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class",
             "const", "continue", "default", "do", "double", "else", "enum", "extends", "false",
             "final", "finally", "float", "for", "goto", "if", "implements", "import",
             "instanceof", "int", "interface", "long", "native", "new", "null", "package",
             "private", "protected", "public", "return", "short", "static", "strictfp", "super",
             "switch", "synchronized", "this", "throw", "throws", "transient", "true", "try",
             "void", "volatile", "while"),
}
ROOTS: dict[str, str] = {"python": "module", "java": "program"}


def token(step: int, is_node: bool, kind: Column, n_bytes: Column, text: Column | None = None) -> Column:
    own = [] if text is None else [text.alias("text")]
    return F.struct(F.lit(step).alias("step"), F.lit(is_node).alias("is_node"),
                    kind.alias("type"), n_bytes.cast("int").alias("n_bytes"), *own)


def _all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def markup_tokens(html: Column) -> Column:
    """Tags open and close nodes (whatever their names); comments, declarations, void or
    self-closed tags and the text between tags are leaves."""
    def classify(t: Column) -> Column:
        size = F.octet_length(t)
        name = F.lower(F.regexp_extract(t, "^<([A-Za-z][A-Za-z0-9:-]*)", 1))
        alone = t.endswith("/>") | name.isin(*VOID_TAGS)
        return (F.when(~t.startswith("<"), token(0, True, F.lit("text"), size))
                .when(t.startswith("</"), token(-1, False, F.lit(None).cast("string"), size))
                .when(t.startswith("<!--"), token(0, True, F.lit("comment"), size))
                .when(t.startswith("<!") | t.startswith("<?"),
                      token(0, True, F.lit("declaration"), size))
                .when(name == "", token(0, True, F.lit("text"), size))
                .when(alone, token(0, True, name, size))
                .otherwise(token(1, True, name, size)))

    return F.transform(_all_matches(html, MARKUP), classify)


def code_tokens(code: Column, language: str, texts: bool = False) -> Column:
    """Brackets open and close nodes and are their first and last leaf; names, keywords,
    numbers, strings, comments and operators are leaves; white space is no node. With ``texts`` leaves
    keep their text."""
    def classify(t: Column) -> Column:
        size = F.octet_length(t)
        none = F.lit(None).cast("string")
        leaf = lambda kind: F.array(token(0, True, kind, size, t if texts else None))
        no_text = none if texts else None
        comment = t.startswith("#") if language == "python" else (
            t.startswith("//") | t.startswith("/*"))
        group = (F.when(t == "(", F.lit("parenthesized")).when(t == "[", F.lit("bracketed"))
                  .otherwise(F.lit("block")))
        opened = F.concat(F.array(token(1, True, group, F.lit(0), no_text)), leaf(t))
        closed = F.concat(leaf(t), F.array(token(-1, False, none, F.lit(0), no_text)))
        number = F.when(t.rlike(r"^[0-9]+$"), F.lit("integer")).otherwise(F.lit("float"))
        return (F.when(t.isin("(", "[", "{"), opened)
                .when(t.isin(")", "]", "}"), closed)
                .when(t.rlike(r"^\s"), F.array(token(0, False, none, size, no_text)))
                .when(comment & (F.length(t) > 1), leaf(F.lit("comment")))
                .when(t.startswith('"') | t.startswith("'"), leaf(F.lit("string")))
                .when(t.rlike(r"^\p{N}"), leaf(number))
                .when(t.rlike(r"^[\p{L}_$]") & ~t.isin(*KEYWORDS[language]),
                      leaf(F.lit("identifier")))
                .otherwise(leaf(t)))

    return F.flatten(F.transform(_all_matches(code, CODE[language]), classify))


def by_language(language: Column, expressions: Mapping[str, Column],
                result_type: str, policy: str = "fail") -> Column:
    """The expression of the row's language. Others stop the job, or give null (``keep``)."""
    unknown = F.concat(F.lit("no token rules for language: "), F.coalesce(language, F.lit("none")))
    other = F.lit(None) if policy == "keep" else F.raise_error(unknown)
    chosen = F
    for name, expression in expressions.items():
        chosen = chosen.when(language == name, expression)
    return chosen.otherwise(other.cast(result_type))

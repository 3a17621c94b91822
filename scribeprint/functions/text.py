"""Column expressions on text. All run inside the JVM; none needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space between words: the Unicode property, and the four separators U+001C to U+001F.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def clean_text(code: Column) -> Column:
    """CRLF becomes LF, then a tab becomes four spaces. A lone CR stays."""
    unix = F.replace(code, F.lit("\r\n"), F.lit("\n"))
    return F.replace(unix, F.lit("\t"), F.lit("    "))


def universal_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF, as when a text file is opened in text mode."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.replace(unix, F.lit("\r"), F.lit("\n"))


def substring_count(s: Column, needle: str) -> Column:
    """How often ``needle`` occurs in ``s``: case-sensitive, left to right, no overlaps."""
    taken_out = F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))
    return taken_out if len(needle) == 1 else (taken_out / len(needle)).cast("int")


def words(s: Column) -> Column:
    """Words between runs of white space, as an array without empty strings."""
    return F.array_remove(F.split(s, WHITESPACE), "")


def repetition_ratio(tokens: Column) -> Column:
    """Tokens per distinct token; 0 for an empty list."""
    n_distinct = F.size(F.array_distinct(tokens))
    return F.when(F.size(tokens) > 0, F.size(tokens) / n_distinct).otherwise(F.lit(0.0))

"""Label checks. Each maps a source's own label to 0 (human) or 1 (AI), null when invalid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeprint.schema import AI, HUMAN


def label_from_prefix(file_name: Column) -> Column:
    """Folder sources: the text before the first ``_``, with inverted meaning."""
    prefix = F.substring_index(file_name, "_", 1)
    return F.when(prefix == "1", F.lit(HUMAN)).when(prefix == "0", F.lit(AI))


def label_from_word(word: Column) -> Column:
    """CSV sources: ``lm`` or ``human``."""
    return F.when(word == "lm", F.lit(AI)).when(word == "human", F.lit(HUMAN))


def label_from_number(text: Column) -> Column:
    """JSONL sources: the JSON spelling of a value equal to 0 or 1 (``1.0`` and ``true`` too)."""
    number = F.coalesce(text.try_cast("double"),
                        F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)))
    return F.when(number == 0, F.lit(HUMAN)).when(number == 1, F.lit(AI))


def enforce(df: DataFrame, policy: str = "fail") -> DataFrame:
    """Act on the ``reject`` column (a reason, or null for a good row).

    ``fail`` stops the job at the first bad row, ``drop`` removes bad rows, and
    ``keep`` leaves the column in place so that they can be written elsewhere.
    """
    if policy == "keep":
        return df
    if policy == "drop":
        return df.filter(F.col("reject").isNull()).drop("reject")
    if policy == "fail":
        good = F.when(F.col("reject").isNull(), F.lit(True)).otherwise(
            F.raise_error(F.col("reject")).cast("boolean"))
        return df.filter(good).drop("reject")
    raise ValueError(f"unknown policy {policy!r}: use fail, drop or keep")


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the rejected ones with their reason."""
    return enforce(df, "drop"), df.filter(F.col("reject").isNotNull())

"""Join of a large table with a per-key table, nulls matching nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str],
                how: str = "inner") -> DataFrame:
    """``big`` with the columns of ``small``, matched on ``on``.

    A plain equi-join without a hint: adaptive execution broadcasts a side that turns out small and
    splits a key that turns out hot.
    """
    renamed = {c: f"__{c}" for c in on}
    return big.join(small.withColumnsRenamed(renamed), same_keys(on), how).drop(*renamed.values())


def same_keys(on: Sequence[str]) -> Column:
    """Each column equals its ``__`` twin of the other side; null equals null."""
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return condition

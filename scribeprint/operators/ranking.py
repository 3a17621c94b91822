"""Exact, repeatable cuts of a table in pseudo-random order, without sorting it.

Rows of a stratum are ordered by ``(md5(seed | purpose | id), id)``. Putting a
stratum into one window to number its rows would put it into one task, and a
stratum may hold most of the table. Instead:

1. count rows per (stratum, first four hex digits of the hash): at most 65,536
   small rows per stratum, with partial counts made before the shuffle;
2. find, from running totals of those counts, the one bucket each cut falls in;
3. number only the rows of those buckets, to get the exact (hash, id) at the cut;
4. compare each row with the cuts of its stratum: a map-only pass.

A bucket holds 1/65,536 of a stratum. Where that is still too much for one task, ``levels`` refines the
bucket at each cut by its next four digits, again from counts, before any row of it is numbered: with two levels a
bucket is 1/4,294,967,296 of its stratum.

The result equals ``row_number() <= k`` in the full order, for any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribeprint.operators.lookup import lookup_join
from scribeprint.session import stored


#: Hex digits that a level adds to a bucket.
DIGITS = 4


def hash_key(id_col: str, seed: int, purpose: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), F.col(id_col).cast("string")))


def bucket_counts(df: DataFrame, strata: Sequence[str], id_col: str, seed: int,
                  purpose: str) -> DataFrame:
    """Rows per stratum and hash bucket: strata, ``bucket``, ``n_bucket``."""
    bucket = F.substring(hash_key(id_col, seed, purpose), 1, DIGITS)
    return (df.select(*strata, bucket.alias("bucket"))
              .groupBy(*strata, "bucket").agg(F.count("*").alias("n_bucket")))


def running_counts(counts: DataFrame, strata: Sequence[str]) -> DataFrame:
    """``counts`` plus ``upto`` (rows of the stratum up to and in the bucket) and ``n`` (all)."""
    in_order = Window.partitionBy(*strata).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (counts.withColumn("upto", F.sum("n_bucket").over(in_order))
                  .withColumn("n", F.sum("n_bucket").over(Window.partitionBy(*strata))))


def with_cuts(df: DataFrame, running: DataFrame, strata: Sequence[str], cuts: Sequence[str],
              id_col: str, seed: int, purpose: str, store: bool = False, levels: int = 1) -> DataFrame:
    """``df`` plus one boolean column per name in ``cuts``: is the row among the first k?

    ``running`` is ``running_counts`` plus a column of that name holding k, the same in all
    rows of a stratum. With ``store`` the cut points, one row per stratum, are worked out at once and
    kept in the shared folder; for results that are read several times. ``levels``: see above.
    """
    strata, cuts = list(strata), list(cuts)
    points = _cut_points(df, running, strata, cuts, id_col, seed, purpose, levels)
    points = stored(points, "cut-points") if store else points
    keyed = df.withColumn("__h", hash_key(id_col, seed, purpose))
    keyed = keyed.withColumn("__zero", _zero(F.col("__h")))
    joined = lookup_join(keyed, points, [*strata, "__zero"], "left").drop("__zero")
    h, i = F.col("__h"), F.col(id_col)
    for cut in cuts:  # a stratum of which a cut takes nothing has no point
        last = F.col(f"__{cut}")
        inside = (h < last["h"]) | ((h == last["h"]) & (i <= last["id"]))
        joined = joined.withColumn(cut, F.coalesce(inside, F.lit(False)))
    return joined.drop("__h", *[f"__{cut}" for cut in cuts])


def _cut_points(df: DataFrame, running: DataFrame, strata: list[str], cuts: list[str],
                id_col: str, seed: int, purpose: str, levels: int) -> DataFrame:
    """One row per stratum with, per cut, ``struct(h, id)`` of the last row inside."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).cast("bigint").alias("k"))
                                for c in cuts]))
    upto, before = F.col("upto"), F.col("upto") - F.col("n_bucket")
    k = F.least(F.col("w.k"), F.col("n"))
    ends = running.select("*", named.alias("w")).filter((upto >= k) & (before < k)).select(
        *strata, "w.cut", "bucket", (k - before).alias("need"), (k == F.col("n")).alias("whole"))

    rows = df.select(*strata, F.col(id_col).alias("id"), hash_key(id_col, seed, purpose).alias("h"))
    in_bucket = lambda ends, level: lookup_join(
        rows.withColumn("bucket", F.substring("h", 1, DIGITS * level)), ends, [*strata, "bucket"])
    for level in range(2, levels + 1):
        ends = _refined(in_bucket(ends, level - 1), strata, DIGITS * level)
    in_end = in_bucket(ends, levels)
    order = Window.partitionBy(*strata, "cut", "bucket").orderBy("h", "id")
    # Rows of one id cannot be told apart, so a cut between them has no right place.
    repeated = F.raise_error(F.concat(F.lit("repeated id: "), F.col("id").cast("string")))
    between = ~F.col("whole") & F.col("next").eqNullSafe(F.col("id")) & F.col("id").isNotNull()
    last = (in_end.withColumn("rank", F.row_number().over(order))
                  .withColumn("next", F.lead("id").over(order))
                  .filter(F.col("rank") == F.col("need"))
                  .withColumn("id", F.when(between, repeated.cast(df.schema[id_col].dataType))
                              .otherwise(F.col("id"))))
    points = last.groupBy(*strata).agg(*[
        F.max(F.when(F.col("cut") == c, F.struct("h", "id"))).alias(f"__{c}") for c in cuts])
    known = F.coalesce(*[F.col(f"__{c}.h") for c in cuts])
    return points.withColumn("__zero", _zero(known))


def _refined(in_end: DataFrame, strata: list[str], digits: int) -> DataFrame:
    """The bucket of so many digits at each cut, from the rows of the bucket that was known before."""
    own = [*strata, "cut", "need", "whole"]
    counts = in_end.withColumn("bucket", F.substring("h", 1, digits)).groupBy(*own, "bucket").agg(
        F.count("*").alias("n_bucket"))
    order = Window.partitionBy(*strata, "cut").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n_bucket").over(order))
    before = F.col("upto") - F.col("n_bucket")
    return upto.filter((F.col("upto") >= F.col("need")) & (before < F.col("need"))).select(
        *strata, "cut", "bucket", (F.col("need") - before).alias("need"), "whole")


def _zero(text: Column) -> Column:
    """0, worked out from a row: strata of a single constant value would leave no equality to join on."""
    return F.pmod(F.length(text), F.lit(1))

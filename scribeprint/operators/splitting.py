"""Stratified caps and train / val / test splits with exact, repeatable sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scribeprint.operators.lookup import lookup_join
from scribeprint.operators.ranking import bucket_counts, hash_key, running_counts, with_cuts

SEED = 42


#: Names of a config that are tests against constants; more of them are a join.
LITERAL_NAMES = 64
SETTINGS = {"test_size": "double", "val_size": "double", "max_sample_count": "bigint"}

Config = Mapping[str, Mapping[str, float]] | DataFrame


def config_table(spark: SparkSession, config: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``dataset, test_size, val_size, max_sample_count`` of a config; null where nothing is said."""
    rows = [(name, *[None if c.get(k) is None else kind(c[k]) for k, kind in (
        ("test_size", float), ("val_size", float), ("max_sample_count", int))]) for name, c in config.items()]
    return spark.createDataFrame(rows, "dataset string, " + ", ".join(f"{k} {t}" for k, t in SETTINGS.items()))


def _is_table(config: Config | None) -> bool:
    return isinstance(config, DataFrame) or (config is not None and len(config) > LITERAL_NAMES)


def _as_table(df: DataFrame, config: Config) -> DataFrame:
    return config if isinstance(config, DataFrame) else config_table(df.sparkSession, config)


def filter_datasets(df: DataFrame, config: Config | None = None,
                    name: str | None = None, language: str | None = None) -> DataFrame:
    """Keep the datasets a run asks for. All tests are exact and case-sensitive.

    A short config is a test against constants that reaches the scan. A table of configs (or a long one) is a left
    semi join: adaptive execution broadcasts it while it is small, and if it is itself a filter of a larger table,
    such as the configs of one run, only the partitions of its datasets are read of samples stored by dataset.
    """
    if _is_table(config):
        names = _as_table(df, config).select("dataset")
        df = df.join(names, "dataset", "left_semi").select(*df.columns)
    elif config:
        df = df.filter(F.col("dataset").isin(*config))
    if name:
        df = df.filter(F.col("dataset") == name)
    if language:
        df = df.filter(F.col("language") == language)
    return df


def with_config(df: DataFrame, config: Config) -> DataFrame:
    """``df`` with the split sizes and cap of its dataset; every entry of one name shares them.

    A short config is read from literals, so no join is needed; a table, or a long one, is joined. Names of a
    table must not repeat.
    """
    if _is_table(config):
        table = _as_table(df, config).select("dataset", *SETTINGS)
        found = lookup_join(df, table, ["dataset"], "left")
        return found.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("test_size", "val_size")})

    def setting(key: str) -> Column:
        pairs = [F.lit(v) for name, c in config.items() if c.get(key) is not None
                 for v in (name, float(c[key]))]
        if not pairs:
            return F.lit(None).cast(SETTINGS[key])
        return F.element_at(F.create_map(*pairs), F.col("dataset")).cast(SETTINGS[key])

    return (df.withColumn("test_size", F.coalesce(setting("test_size"), F.lit(0.0)))
              .withColumn("val_size", F.coalesce(setting("val_size"), F.lit(0.0)))
              .withColumn("max_sample_count", setting("max_sample_count")))


def with_quotas(running: DataFrame, strata: Sequence[str], label: str = "label",
                cap: int | str = "max_sample_count") -> DataFrame:
    """``running`` counts of (stratum, label) plus ``keep``: rows to keep of the label, so that
    the label ratio holds and the sum is the cap.

    Each label gets the floor of its share; what is left goes to the largest
    fractions, the lower label first on a tie. Without a cap, or with one that
    is not below the stratum's size, every row is kept.
    """
    whole = Window.partitionBy(*strata)
    size = F.col(cap) if isinstance(cap, str) else F.lit(cap).cast("bigint")
    # A label has a row for each hash bucket; the last one counts for it.
    of_label = lambda c: F.when(F.col("upto") == F.col("n"), c)
    total = F.sum(F.col("n_bucket")).over(whole)
    shares = (running.withColumn("__all", total)
                     .withColumn("__size", F.least(F.coalesce(size, F.col("__all")), F.col("__all")))
                     # whole numbers only, so the shares are exact, and wide enough for any two counts
                     .withColumn("__product", F.col("__size").cast("decimal(19,0)")
                                 * F.col("n").cast("decimal(19,0)"))
                     .withColumn("__floor", F.expr("__product div __all"))
                     .withColumn("__rest", F.col("__product") % F.col("__all"))
                     .withColumn("__left", F.col("__size") - F.sum(of_label(F.col("__floor"))).over(whole)))
    turn = F.dense_rank().over(whole.orderBy(F.desc("__rest"), F.asc(label)))
    keep = F.col("__floor") + (turn <= F.col("__left")).cast("bigint")
    return shares.withColumn("keep", keep).drop("__all", "__size", "__product", "__floor", "__rest", "__left")


def stratified_cap(df: DataFrame, cap: int | str = "max_sample_count",
                   strata: Sequence[str] = ("dataset", "language", "ai"), label: str = "label",
                   id_col: str = "sample_id", seed: int = SEED, store: bool = False,
                   levels: int = 1) -> DataFrame:
    """At most ``cap`` rows per stratum (a number, or the column that holds it); the ratio of
    the labels is kept. ``store`` keeps the cut points, ``levels`` refines buckets (see ``ranking.with_cuts``)."""
    groups = [*strata, label]
    carried = [cap] if isinstance(cap, str) else []
    counts = bucket_counts(df, [*groups, *carried], id_col, seed, "cap")
    running = with_quotas(running_counts(counts, groups), strata, label, cap)
    kept = with_cuts(df, running, groups, ["keep"], id_col, seed, "cap", store, levels)
    return kept.filter("keep").drop("keep")


def split_counts(n: Column, test_size: Column, val_size: Column) -> tuple[Column, Column]:
    """``(n_test, n_val)`` of ``n`` rows, in doubles and in this order of operations:
    the test rows are taken first, and the validation share is rescaled to the rest."""
    n_test = F.when(test_size == 1, n).otherwise(F.ceil(test_size * n))
    share = val_size / F.when(test_size == 1, F.lit(1.0)).otherwise(F.lit(1.0) - test_size)
    n_val = F.when(test_size == 1, F.lit(0)).otherwise(F.ceil(share * (n - n_test)))
    return n_test.cast("bigint"), n_val.cast("bigint")


def split_dataset(df: DataFrame, test_size: float | str = 0.1, val_size: float | str = 0.1,
                  strata: Sequence[str] = ("dataset", "language", "ai"),
                  id_col: str = "sample_id", seed: int = SEED, levels: int = 1) -> DataFrame:
    """``df`` plus a ``split`` column: test, val or train, of exact sizes per stratum.

    Sizes are numbers, or the names of columns that are constant inside a stratum.
    ``test_size`` 1 sends every row to test, 0 makes a two-way split.
    """
    strata = list(strata)
    if not strata:
        raise ValueError("name at least one stratum column")
    sizes = {k: v for k, v in (("test_size", test_size), ("val_size", val_size))}
    carried = [v for v in sizes.values() if isinstance(v, str)]
    counts = bucket_counts(df, [*strata, *carried], id_col, seed, "split")
    test, val = (F.col(v) if isinstance(v, str) else F.lit(float(v)) for v in sizes.values())
    n_test, n_val = split_counts(F.col("n"), test, val)
    running = (running_counts(counts, strata).withColumn("to_test", n_test)
               .withColumn("to_val", F.col("to_test") + n_val))
    cut = with_cuts(df, running, strata, ["to_test", "to_val"], id_col, seed, "split", levels=levels)
    split = F.when(F.col("to_test"), F.lit("test")).when(F.col("to_val"), F.lit("val"))
    return cut.withColumn("split", split.otherwise(F.lit("train"))).drop("to_test", "to_val")


def split_dataset_approx(df: DataFrame, test_size: float = 0.1, val_size: float = 0.1,
                         id_col: str = "sample_id", seed: int = SEED) -> DataFrame:
    """As ``split_dataset`` in one map-only pass, with sizes that are right only on average."""
    share = F.conv(F.substring(hash_key(id_col, seed, "split"), 1, 8), 16, 10).cast(
        "double") / F.lit(float(1 << 32))
    split = (F.when(share < test_size, F.lit("test"))
              .when(share < test_size + val_size, F.lit("val")).otherwise(F.lit("train")))
    return df.withColumn("split", split)


def split_datasets(samples: DataFrame, test_size: float | None = None,
                   val_size: float | None = None, max_sample_count: int | None = None,
                   name: str | None = None, language: str | None = None,
                   config: Config | None = None,
                   id_col: str = "sample_id", seed: int = SEED) -> DataFrame:
    """Filter, cap and split all datasets: ``samples`` plus ``split``.

    Either ``config`` (sizes and cap per dataset name, or a table of them) or both sizes are needed. A split reads its
    input three times, so the cut points of a cap before it are stored and not found three times.
    """
    if (config is None or (not isinstance(config, DataFrame) and not config)) and not (test_size and val_size):
        raise ValueError("give either config, or test_size and val_size (both above 0)")
    strata = ["dataset", "language", "ai"]
    df = filter_datasets(samples, config, name, language)
    if isinstance(config, DataFrame) or config:
        df = with_config(df, config)
        if isinstance(config, DataFrame) or any(c.get("max_sample_count") is not None for c in config.values()):
            df = stratified_cap(df, "max_sample_count", strata, id_col=id_col, seed=seed, store=True)
        df = split_dataset(df, "test_size", "val_size", strata, id_col, seed)
        return df.drop("test_size", "val_size", "max_sample_count")
    if max_sample_count is not None:
        df = stratified_cap(df, max_sample_count, strata, id_col=id_col, seed=seed, store=True)
    return split_dataset(df, test_size, val_size, strata, id_col, seed)


def union_splits(*parts: DataFrame) -> DataFrame:
    """All rows of several split tables, copies included."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def split_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per dataset entry and split, plus one row named ``Total`` over everything, for
    each group of ``by``."""
    counted = df.groupingSets(
        [[*by, "dataset", "language", "ai"], [*by]], *by, "dataset", "language", "ai").agg(
        F.grouping("dataset").alias("is_total"),
        F.count("*").alias("total"),
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")])
    return counted.select(
        *by, F.when(F.col("is_total") == 1, F.lit("Total")).otherwise(F.col("dataset")).alias("dataset"),
        "language", "ai", "total", "train", "val", "test")

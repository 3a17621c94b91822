import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scribeprint.operators import ranking, splitting
from scribeprint.operators.ranking import hash_key, running_counts
from scribeprint.sources import sinks


def table(spark, sizes, partitions=4):
    """One dataset per size, with every third row of label 1."""
    rows = [(f"{name}-{i}", name, int(i % 3 == 0)) for name, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, dataset string, label int").repartition(
        partitions).withColumn("language", F.lit("python")).withColumn("ai", F.lit(None).cast("string"))


def by_rank(df, seed, purpose, *strata):
    order = Window.partitionBy(*strata).orderBy(hash_key("sample_id", seed, purpose), "sample_id")
    return df.withColumn("rank", F.row_number().over(order))


SIZES = {f"d{n}": n for n in [*range(1, 41), 99, 100, 101, 500, 999, 1000]}


def expected_sizes(n, test, val):
    if test == 1:
        return n, 0
    n_test = math.ceil(test * n)
    return n_test, math.ceil(val / (1 - test) * (n - n_test))


@pytest.mark.parametrize("test,val", [(0.1, 0.1), (0.2, 0.1), (0, 0.2), (1, 0), (0.25, 0.25)])
def test_sizes_are_exact(spark, test, val):
    split = splitting.split_dataset(table(spark, SIZES), test, val, ["dataset"])
    counts = {}
    for name, part, n in split.groupBy("dataset", "split").count().collect():
        counts.setdefault(name, {})[part] = n
    for name, n in SIZES.items():
        n_test, n_val = expected_sizes(n, test, val)
        got = counts[name]
        assert (got.get("test", 0), got.get("val", 0)) == (n_test, min(n_val, n - n_test)), name
        assert sum(got.values()) == n


def test_rescaled_share_is_computed_in_doubles(spark):
    df = spark.createDataFrame([(5000,)], "n bigint")
    n_test, n_val = splitting.split_counts(F.col("n"), F.lit(0.1), F.lit(0.1))
    assert tuple(df.select(n_test, n_val).first()) == (500, 501)


def test_equals_full_sort_under_any_partitioning(spark):
    sizes = {"big": 2000, "small": 7, "one": 1}
    found = set()
    for partitions in (1, 4, 32):
        df = table(spark, sizes, partitions)
        split = splitting.split_dataset(df, 0.1, 0.1, ["dataset"])
        found.add(tuple(sorted(map(tuple, split.select("sample_id", "split").collect()))))
    assert len(found) == 1
    ranked = by_rank(table(spark, sizes), 42, "split", "dataset")
    parts = dict(next(iter(found)))
    for row in ranked.collect():
        n_test, n_val = expected_sizes(sizes[row["dataset"]], 0.1, 0.1)
        want = "test" if row["rank"] <= n_test else "val" if row["rank"] <= n_test + n_val else "train"
        assert parts[row["sample_id"]] == want


def test_another_seed_gives_another_split(spark):
    df = table(spark, {"a": 200})
    a, b = (splitting.split_dataset(df, 0.5, 0.1, ["dataset"], seed=s).filter("split = 'test'")
            for s in (1, 2))
    assert a.count() == b.count() == 100
    assert a.join(b, "sample_id").count() < 100


@pytest.mark.parametrize("cap", [1, 2, 10, 37, 99, 100, 101, 5000])
def test_cap_is_exact_and_keeps_the_ratio(spark, cap):
    df = table(spark, SIZES)
    kept = splitting.stratified_cap(df, cap, ["dataset"])
    rows = {(r["dataset"], r["label"]): r["count"] for r in kept.groupBy("dataset", "label").count().collect()}
    for name, n in SIZES.items():
        size = min(cap, n)
        per_label = [rows.get((name, label), 0) for label in (0, 1)]
        assert sum(per_label) == size
        ones = (n + 2) // 3
        assert abs(per_label[1] - size * ones / n) < 1


def test_cap_ties_go_to_the_lower_label(spark):
    rows = [(f"s{i}", "a", i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "sample_id string, dataset string, label int")
    kept = splitting.stratified_cap(df, 5, ["dataset"]).groupBy("label").count()
    assert dict(map(tuple, kept.collect())) == {0: 3, 1: 2}


def test_plans_are_built_without_a_job(spark):
    df = table(spark, SIZES)
    spark.sparkContext.setJobGroup("splitting", "")
    splitting.stratified_cap(df, 50)
    splitting.split_dataset(df, 0.1, 0.1)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("splitting")


def test_quotas_of_very_large_counts(spark):
    counts = spark.createDataFrame(
        [("a", 0, "0001", 10**12), ("a", 0, "0002", 2 * 10**12), ("a", 1, "0001", 10**12),
         ("b", 0, "0001", 4 * 10**9), ("b", 1, "0003", 10**9)],
        "dataset string, label int, bucket string, n_bucket long").withColumn(
            "max_sample_count", F.lit(None).cast("bigint"))
    running = running_counts(counts, ["dataset", "label"])

    def kept(**cap):
        rows = splitting.with_quotas(running, ["dataset"], **cap).select("dataset", "label", "keep").distinct()
        return sorted(map(tuple, rows.collect()))

    assert kept() == [("a", 0, 3 * 10**12), ("a", 1, 10**12), ("b", 0, 4 * 10**9), ("b", 1, 10**9)]
    assert kept(cap=2 * 10**12 + 1)[:2] == [("a", 0, 15 * 10**11 + 1), ("a", 1, 5 * 10**11)]


def test_a_cut_between_rows_of_one_id_stops(spark):
    rows = [("same" if i < 50 else f"s{i}", "a") for i in range(100)]
    df = spark.createDataFrame(rows, "sample_id string, dataset string")
    first = df.select(hash_key("sample_id", splitting.SEED, "split").alias("h"), "sample_id")
    below = first.filter(F.col("h") < first.filter("sample_id = 'same'").first()["h"]).count()
    with pytest.raises(Exception, match="repeated id: same"):
        splitting.split_dataset(df, (below + 10) / 100, 0.1, ["dataset"]).collect()


def test_config_sets_sizes_per_dataset(spark):
    df = table(spark, {"a": 50, "b": 50, "c": 50, "d": 50})
    config = {"a": {"test_size": 1}, "b": {"val_size": 0.2},
              "c": {"val_size": 0.2, "max_sample_count": 20}, "nowhere": {}}
    split = splitting.split_datasets(df, config=config)
    summary = {r["dataset"]: tuple(r)[3:] for r in splitting.split_summary(split).collect()}
    assert summary == {"a": (50, 0, 0, 50), "b": (50, 40, 10, 0), "c": (20, 16, 4, 0),
                       "Total": (120, 56, 14, 50)}


def test_filters_are_exact(spark):
    df = table(spark, {"a": 5, "b": 5, "A": 5})
    assert splitting.filter_datasets(df, name="a").count() == 5
    assert splitting.filter_datasets(df, language="Python").count() == 0
    assert splitting.filter_datasets(df, {"a": {}, "b": {}}, name="b").count() == 5


def test_argument_rules(spark):
    df = table(spark, {"a": 5})
    for bad in ({}, {"test_size": 0.1}, {"test_size": 0.1, "val_size": 0}, {"config": {}}):
        with pytest.raises(ValueError):
            splitting.split_datasets(df, **bad)
    with pytest.raises(ValueError):
        splitting.split_dataset(df, strata=[])


def test_one_constant_dataset(spark):
    df = spark.range(100).selectExpr("CAST(id AS string) AS sample_id", "'only' AS dataset")
    split = splitting.split_dataset(df, 0.1, 0.2, ["dataset"])
    assert dict(map(tuple, split.groupBy("split").count().collect())) == {
        "test": 10, "val": 20, "train": 70}
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_approximate_split_covers_all_rows(spark):
    split = splitting.split_dataset_approx(table(spark, {"a": 2000}), 0.1, 0.1)
    counts = dict(map(tuple, split.groupBy("split").count().collect()))
    assert sum(counts.values()) == 2000
    assert 140 < counts["test"] < 260 and 140 < counts["val"] < 260


def test_two_levels_cut_where_one_does(spark):
    df = spark.range(3_000).select(F.col("id").cast("string").alias("sample_id"), F.lit("one").alias("dataset"),
                                   (F.col("id") % 3 == 0).cast("int").alias("label"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    for levels in (2, 3):
        assert rows(splitting.split_dataset(df, 0.2, 0.3, ["dataset"], levels=levels)) == rows(
            splitting.split_dataset(df, 0.2, 0.3, ["dataset"]))
        assert rows(splitting.stratified_cap(df, 777, ["dataset"], levels=levels)) == rows(
            splitting.stratified_cap(df, 777, ["dataset"]))


def test_a_level_goes_on_inside_of_a_full_bucket(spark, monkeypatch):
    """With buckets of one digit, the second level is needed, and no bucket that is numbered has many rows."""
    monkeypatch.setattr(ranking, "DIGITS", 1)
    df = spark.range(4_000).select(F.col("id").cast("string").alias("sample_id"), F.lit("one").alias("dataset"))
    counts = ranking.running_counts(ranking.bucket_counts(df, ["dataset"], "sample_id", 42, "split"), ["dataset"])
    assert counts.count() == 16
    running = counts.withColumn("first", F.lit(1234))
    cut = {levels: ranking.with_cuts(df, running, ["dataset"], ["first"], "sample_id", 42, "split", levels=levels)
           for levels in (1, 2, 3)}
    first = {levels: {r[0] for r in d.filter("first").select("sample_id").collect()} for levels, d in cut.items()}
    assert first[1] == first[2] == first[3] and len(first[1]) == 1234


def test_configs_as_a_table(spark, tmp_path):
    names = 100_000
    config = spark.range(names).select(
        F.concat(F.lit("d"), "id").alias("dataset"), F.lit(0.1).alias("test_size"), F.lit(None).cast("double").alias("val_size"),
        (F.col("id") % 7).alias("max_sample_count"), F.when(F.col("id") < 3, "small").otherwise("rest").alias("run"))
    samples = spark.range(400).select(
        F.col("id").cast("string").alias("sample_id"), F.concat(F.lit("d"), F.col("id") % 8).alias("dataset"),
        F.lit("java").alias("language"), F.lit("m").alias("ai"), F.lit("x").alias("code"), (F.col("id") % 2).cast("int").alias("label"))
    path = str(tmp_path / "samples")
    stored = sinks.write_samples(samples, path)
    own = config.filter("run = 'small'").drop("run")
    kept = splitting.filter_datasets(stored, own)
    assert {r[0] for r in kept.select("dataset").distinct().collect()} == {"d0", "d1", "d2"}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    found = splitting.with_config(samples, config.drop("run"))
    assert found.filter("test_size = 0.1 AND val_size = 0.0").count() == 400
    settings = {f"d{k}": {"test_size": 0.1, "max_sample_count": k % 7} for k in range(200)}
    as_dict = splitting.with_config(samples, settings).orderBy("sample_id").collect()
    assert as_dict == found.orderBy("sample_id").collect()
    by_table = splitting.split_datasets(samples, config=own)
    by_dict = splitting.split_datasets(samples, config={f"d{k}": settings[f"d{k}"] for k in range(3)})
    assert sorted(map(tuple, by_table.collect())) == sorted(map(tuple, by_dict.collect()))

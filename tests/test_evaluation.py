import random

import pytest

from scribeprint.operators import evaluation as E


def predictions(spark, pairs, group="g"):
    return spark.createDataFrame([(group, t, p) for t, p in pairs],
                                 "lang string, y_true int, y_pred int")


PAIRS = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 0)] * 1 + [(1, 1)] * 4


def test_confusion_matrix(spark):
    rows = {r["actual"]: tuple(r)[1:] for r in E.confusion_matrix(predictions(spark, PAIRS)).collect()}
    assert rows == {0: (5, 2), 1: (1, 4)}


def test_one_class_still_gives_two_by_two(spark):
    rows = {r["actual"]: tuple(r)[1:]
            for r in E.confusion_matrix(predictions(spark, [(1, 1)] * 3)).collect()}
    assert rows == {0: (0, 0), 1: (0, 3)}
    m = E.binary_metrics(predictions(spark, [(1, 1)] * 3)).first()
    assert (m["accuracy"], m["recall"], m["false_positive_rate"], m["false_negative_rate"]) == (
        1.0, 1.0, None, 0.0)


def test_rates_and_display(spark):
    m = E.binary_metrics(predictions(spark, PAIRS), ["lang"])
    row = m.first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (5, 2, 1, 4)
    assert row["accuracy"] == 9 / 12 and row["recall"] == 4 / 5
    assert row["false_positive_rate"] == 2 / 7 and row["false_negative_rate"] == 1 / 5
    shown = E.as_percent(m).first()
    assert (shown["accuracy"], shown["false_positive_rate"]) == ("75.00%", "28.57%")


def test_display_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(1 / 32,), (3 / 32,), (0.285,), (None,), (1.0,)], "accuracy double")
    shown = [r[0] for r in E.as_percent(df, ["accuracy"]).collect()]
    assert shown == ["3.12%", "9.38%", "28.50%", None, "100.00%"]


def report(pairs):
    """Per class and averaged scores by counting."""
    rows, n = {}, len(pairs)
    for c, name in ((0, "Human"), (1, "AI")):
        hit = sum(t == c and p == c for t, p in pairs)
        said, support = sum(p == c for _, p in pairs), sum(t == c for t, _ in pairs)
        pr, re = hit / said if said else 0.0, hit / support if support else 0.0
        rows[name] = (pr, re, 2 * pr * re / (pr + re) if pr + re else 0.0, support)
    both = list(rows.values())
    rows["macro avg"] = (*[(a + b) / 2 for a, b in list(zip(*both))[:3]], n)
    rows["weighted avg"] = (*[(a * both[0][3] + b * both[1][3]) / n
                              for a, b in list(zip(*both))[:3]], n)
    rows["accuracy"] = (None, None, sum(t == p for t, p in pairs) / n, n)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_class_report(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 1) * (seed != 3), rng.randint(0, 1) * (seed != 2)) for _ in range(30)]
    got = {r["name"]: tuple(r)[1:] for r in E.class_report(predictions(spark, pairs)).collect()}
    want = report(pairs)
    assert got.keys() == want.keys()
    for name in want:
        assert got[name][3] == want[name][3]
        for a, b in zip(got[name][:3], want[name][:3]):
            assert a is None and b is None or a == pytest.approx(b, abs=1e-12), name


def test_all_groupings_in_one_job(spark):
    df = predictions(spark, PAIRS, "x").union(predictions(spark, PAIRS[:7], None))
    df = df.withColumnRenamed("lang", "source").selectExpr("'en' AS lang", "*")
    rows = E.metrics_by_group(df, [["lang"], ["source"], []])
    got = {(r["lang"], r["source"], r["grouping_id"]): r["tn"] for r in rows.collect()}
    # grouping_id tells the null in the data (1 column grouped) from the total (none).
    assert got == {("en", None, 1): 10, (None, "x", 2): 5, (None, None, 2): 5, (None, None, 3): 10}

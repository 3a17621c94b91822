"""Brute twins and held-out figures of the operators that learn."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

import brute
from scribeprint.llm import decontamination, mixing, quality_rules, resampling, secrets

SF = "/root/testdata/sf0.1"


def auc(scored):
    """Share of pairs (good, bad) that are in order; ties count half."""
    ranked, below, good, area = sorted(scored), 0, sum(y for _, y in scored), 0.0
    k = 0
    while k < len(ranked):
        same = [y for s, y in ranked if s == ranked[k][0]]
        area += sum(same) * (below + (len(same) - sum(same)) / 2)
        below, k = below + len(same) - sum(same), k + len(same)
    return area / (good * (len(scored) - good))


@pytest.fixture(scope="module")
def tables(spark):
    try:
        return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    except Exception:
        pytest.skip("no test data")


def test_held_out_labels(spark, tables):
    """The target model is fitted on half of the labels; how well the other half is told apart is measured: an AUC of
    0.5 would be chance."""
    docs, labels = tables
    fit = F.xxhash64("doc_id") % 2 == 0
    ratios = resampling.resample(docs.select("doc_id", "text"), labels.filter(fit & (F.col("quality") == 1)).select("doc_id"), 0.5)
    rest = ratios.join(labels.filter(~fit), "doc_id").filter("n_words > 0").select(
        "log_ratio", (F.col("log_ratio") / F.col("n_words")).alias("per_word"), "quality").collect()
    whole, per_word = (auc([(r[k], r["quality"]) for r in rest]) for k in ("log_ratio", "per_word"))
    print(f"held-out AUC: {whole:.3f}, per word {per_word:.3f}")
    assert whole > 0.6 and per_word > 0.6


def test_log_ratio_equals_brute_force(spark, monkeypatch):
    """With so many buckets that none is shared, the models are counts of words and pairs."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["a", "b", "C", "d"], k=rng.randrange(0, 12)))) for k in range(40)] + [(50, None), (None, "a b")]
    buckets = 1 << 16
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = spark.createDataFrame([(k,) for k in range(0, 40, 3)], "id long")
    got = resampling.resample(df, good, 0.5, buckets=buckets).collect()
    grams = {d: [(w,) for w in words] + list(zip(words, words[1:])) for d, words in ((d, brute.mark_words(t)) for d, t in rows)}
    raw = [g for v in grams.values() for g in v]
    target = [g for d, v in grams.items() if d is not None and d < 40 and d % 3 == 0 for g in v]
    for r in got:
        expected = sum(math.log((target.count(g) + 1) / (len(target) + buckets)) - math.log((raw.count(g) + 1) / (len(raw) + buckets))
                       for g in grams[r["doc_id"]])
        assert r["log_ratio"] == pytest.approx(expected, abs=1e-9)


def test_hosts_that_fail_are_found(spark):
    """Hosts with rule failures by different shares: recall and precision of the verdict."""
    rng = random.Random(8)
    good, bad = " ".join(f"word{k}" for k in range(60)), " ".join(f"w{k} ###" for k in range(40))
    rows, truth = [], {}
    for h in range(120):
        spam = h % 4 == 0
        truth[f"h{h}"] = spam
        rows += [(len(rows) + k, bad if rng.random() < (0.95 if spam else 0.03) else good, f"h{h}")
                 for k in range(rng.randrange(30, 80))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    hosts = quality_rules.judge_hosts(quality_rules.count_rules(df, "text"), "source").collect()
    said = {r["host"] for r in hosts if r["rejected"]}
    assert said == brute.rejected_hosts(rows)
    hits = sum(truth[h] for h in said)
    assert hits >= 0.9 * sum(truth.values()) and hits >= 0.95 * len(said)


def test_random_strings_are_found_and_identifiers_are_not(spark):
    """A model of the labelled samples, on strings that no pattern takes."""
    rng = random.Random(4)
    syllables = "get set user name list file path count total order item value index cache".split()
    ident = lambda: "_".join(rng.choices(syllables, k=rng.randrange(3, 6)))
    key = lambda n: "".join(rng.choices(secrets.ALPHABET[:62], k=n))
    rows = [(k, f"token = {key(40)} and {ident()} then") for k in range(150)]
    rows += [(1000 + k, " ".join(ident() for _ in range(12))) for k in range(900)]
    rows += [(2000 + k, f"use {key(40)} with {ident()}") for k in range(40)]  # few, as in real files
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "markov"] for r in secrets.find_secrets(df).collect()}
    hits = sum(any(s["start"] == 4 for s in found[2000 + k]) for k in range(40))
    wrong = sum(len(found[1000 + k]) for k in range(900)) + sum(s["start"] > 4 for k in range(40) for s in found[2000 + k])
    print(f"random strings: {hits} of 40, wrong {wrong}")
    assert hits >= 0.85 * 40 and hits >= 0.95 * (hits + wrong)


def test_taken_words_follow_the_schedule(spark):
    """The words taken of a document are those of its slots, and every word of a source is taken as often as another,
    give or take one block."""
    rows = [(k, "w " * (k % 7 + 1), "abc"[k % 3]) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(df, block=8).collect()}
    pieces = {}
    for r in mixing.mix(df, block=8).collect():
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["last_word"] - r["first_word"]
    assert {d: n for d, n in taken.items() if n} == pieces


def test_texts_named_like_results(spark):
    rows = [(1, "x y " * 30, "s"), (2, "what is the capital of the small country in the north", "s")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, rows[1][1])], "item_id long, text string")
    named = plain.withColumnRenamed("text", "items")
    assert [r["doc_id"] for r in decontamination.decontaminate(named, bench, text="items").collect()] == [1]
    own = quality_rules.quality_rules(plain.withColumnRenamed("text", "n_words"), text="n_words").orderBy("doc_id").collect()
    assert [r["n_words"] for r in own] == [60, 11]

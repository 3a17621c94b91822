"""Licence notices: found by rare words and relative position, with changes, and nowhere else."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from scribeprint.llm import licenses

NOTICES = [t for t in licenses.templates() if not t.base]


def prose(rng, n):
    common = "the of and to a in is this that for with as be or not any software license code use file terms".split()
    return [rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(3_000)}" for _ in range(n)]


def changed(rng, words, must, share):
    """So many of the words replaced, left out or doubled, but none of the mandatory phrase."""
    at = next(k for k in range(len(words)) if words[k:k + len(must)] == must)
    out = []
    for k, w in enumerate(words):
        if at <= k < at + len(must) or rng.random() >= share:
            out.append(w)
        else:
            out += rng.choice([[f"w{rng.randrange(3_000)}"], [], [w, f"w{rng.randrange(3_000)}"]])
    return out


@pytest.fixture(scope="module")
def planted():
    """(id, text, label of the notice planted or None)."""
    rng = random.Random(12)
    rows = [(k, " ".join(prose(rng, rng.randrange(5, 900))), None) for k in range(600)]
    for k in range(200):
        t = NOTICES[k % len(NOTICES)]
        body = changed(rng, t.words, t.mandatory, 0.2 * (k % 5 > 0))
        words = prose(rng, rng.randrange(0, 300)) + body + prose(rng, rng.randrange(0, 300))
        rows.append((1000 + k, " ".join(words), t.label))
    for k, t in enumerate(NOTICES):  # all but the mandatory phrase; the phrase alone; the words in another order
        rows.append((2000 + k, " ".join(t.words).replace(" ".join(t.mandatory), "x y z"), None))
        rows.append((2100 + k, " ".join(prose(rng, 40) + t.mandatory + prose(rng, 40)), None))
        rows.append((2200 + k, " ".join(rng.sample(t.words, len(t.words))), None))
    return rows


def found(spark, rows):
    df = spark.createDataFrame([(d, t) for d, t, *_ in rows], "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}


def test_recall_and_precision_with_a_fifth_of_the_words_changed(spark, planted):
    got = found(spark, planted)
    base = set(brute.LICENCE_PHRASES.values())
    said = {d: set(r["labels"]) - base for d, r in got.items()}
    hits = sum(label in said[d] for d, _, label in planted if label)
    names = sum(len(s) for s in said.values())
    assert hits >= 0.9 * sum(label is not None for *_, label in planted)
    assert hits >= 0.95 * names


def test_equals_brute_force(spark, planted):
    rng = random.Random(1)
    rows = rng.sample(planted, 60) + [(9000, None, None), (9001, "", None), (9002, "MIT license, cc by", None)]
    rows.append((9003, " ".join(w for t in NOTICES for w in t.words) + " " + " ".join(NOTICES[4].words), None))
    expected = brute.licence_notices([t for _, t, _ in rows], [(t.label, t.words, t.mandatory) for t in NOTICES])
    got = found(spark, rows)
    for (doc, text, _), (labels, score) in zip(rows, expected):
        own = brute.licence_phrases(text)
        assert set(got[doc]["labels"]) == labels | set(filter(None, own[4].split(",")))
        assert got[doc]["score"] == pytest.approx(1.0 if own[1] else score)


def test_the_text_may_be_named_like_a_result(spark, planted):
    plain = found(spark, planted[600:610])
    df = spark.createDataFrame([(d, t) for d, t, _ in planted[600:610]], "doc_id long, labels string").withColumn("text_", F.lit(1))
    frame = licenses.scan_licenses(df, text="labels")
    assert sorted(frame.columns) == sorted(["doc_id", "text_", *licenses.ADDED])
    assert {r["doc_id"]: r["labels"] for r in frame.collect()} == {d: r["labels"] for d, r in plain.items()}

"""Registered queries against their SQL twins or brute force, and the pipeline stage by stage."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
import brute
import corpus_pipeline
from compare import connect, differences
from scribeprint.llm.oracles import ORACLES
from scribeprint.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_every_operator_is_registered():
    registered = driver.queries()
    assert set(QUERIES) < set(registered) and "pipeline" in registered
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in registered) == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["op1_source_mix", "op3_host_quality", "op5_markov_secrets"])
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"):
        assert word not in plan


def test_secrets(spark, docs):
    texts = dict(docs)
    for r in QUERIES["op5_markov_secrets"](spark, SF).collect():
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute.secrets(texts[r["doc_id"]])


def test_licenses(spark, docs):
    texts = dict(docs)
    for r in QUERIES["op7_license_scan"](spark, SF).collect():
        assert tuple(r)[1:6] == brute.licence_phrases(texts[r["doc_id"]])


def test_token_counts(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in QUERIES["op8_prefix_token_counts"](spark, SF).collect()}
    for doc, text in docs:
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (got[doc]["n_tokens"], got[doc]["over_limit"]) == (n, n > 1024)


def test_token_files(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    got = QUERIES["op11_token_files"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute.token_files(docs, lambda t: lib.encode(t, add_special_tokens=False).ids)


def test_target_resampling(spark, docs):
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_target_resampling"](spark, SF).collect()), key=repr)
    assert got == sorted(((r[0], *r[2:]) for r in brute.target_resampling(docs, target)), key=repr)
    assert sum(r[-1] is not None for r in got) > 0


def test_mix(spark, docs):
    rows = QUERIES["op1_source_mix"](spark, SF).collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((d, len(brute.blank_words(t))) for d, t in docs)
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 1.5 * total) <= 20


def test_sample_favours_good_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op4_importance_resampling"](spark, SF).collect()
    kept = {q: [r["kept"] for r in rows if labels.get(r["doc_id"]) == q] for q in (0, 1)}
    assert sum(kept[1]) / len(kept[1]) > sum(kept[0]) / max(len(kept[0]), 1)


def test_pipeline_stages(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    sourced = [tuple(r) for r in frame.select("doc_id", "text", "source").collect()]
    hosts, rejected = {d: h for d, _, h in sourced}, brute.rejected_hosts(sourced)
    expected = {
        "quality rules": lambda rows: {x[0] for x in brute.quality(rows) if not x[-1] and hosts[x[0]] not in rejected},
        "near dedup": lambda rows: {x[0] for x in brute.near(rows) if x[3]},
        "decontamination": lambda rows: {x[0] for x in brute.contamination(rows, items) if not x[5]},
        "secret scans": lambda rows: {x[0] for x in rows},
    }
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        after = stage(spark, frame, SF).cache()
        if name in expected:
            assert {r["doc_id"] for r in after.collect()} == expected[name](before), name
            assert after.columns == frame.columns
        else:
            assert {r["doc_id"] for r in after.collect()} <= {d for d, _ in before}
        if name == "secret scans":
            assert all(brute.secrets(r["text"])[:3] == (0, 0, 0) for r in after.collect())
        frame = after
    assert corpus_pipeline.run(spark, SF).count() == frame.count()

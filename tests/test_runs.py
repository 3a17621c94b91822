import pytest

from scribeprint.plans import runs
from scribeprint.plans.runs import (ModelOptions, RunConfig, run_report, run_tables,
                                    standard_configs)
from scribeprint.sources.catalog import STANDARD


@pytest.fixture(scope="module")
def samples(spark):
    def code(i, language, ai):
        names = [f"v{(i * 7 + k) % 11}" for k in range(3)]
        if language == "python":
            body = f"def f({', '.join(names)}):\n    return [{names[0]}, {i}]\n"
            return body + ("# computes the result\n" if ai else "")
        return f"class A {{ int {names[0]} = f({i}); {'/* done */' if ai else ''} }}"

    rows = [(f"{d}-{i}", d, lang, "m", code(i, lang, i % 2), i % 2)
            for d, lang in (("a", "python"), ("b", "java"), ("c", "python")) for i in range(30)]
    return spark.createDataFrame(rows, "sample_id string, dataset string, language string, "
                                       "ai string, code string, label int")


def test_report_over_configs_and_models(samples):
    unseen = {"a": {"val_size": 0.2, "max_sample_count": 20}, "b": {"val_size": 0.2},
              "c": {"test_size": 1}}
    configs = [RunConfig("python", 0.2, 0.2, language="python"), RunConfig("unseen", config=unseen)]
    options = ModelOptions(use_scaler=True, add_structural_features=True)
    tables = run_tables(samples, configs, options)
    rows = {(r["config"], r["model"], r["split"]): r for r in tables.metrics.collect()}
    models = ("text", "tree", "blend")
    assert set(rows) == {(c, m, s) for c in ("python", "unseen") for m in models
                         for s in ("val", "test")}

    def n(key):
        return sum(rows[key][c] for c in ("tn", "fp", "fn", "tp"))

    for m in models:
        assert n(("python", m, "test")) == 12 and n(("unseen", m, "test")) == 30
        assert n(("unseen", m, "val")) == 4 + 6
        assert rows["unseen", m, "test"]["seconds"] > 0
    assert rows["python", "blend", "test"]["accuracy"] > 0.9
    reports = tables.class_reports.filter("config = 'unseen' AND model = 'tree' AND split = 'test'")
    assert {r["name"]: r["support"] for r in reports.collect()}["Human"] == 15 and reports.count() == 5
    splits = {(r["config"], r["dataset"]): (r["train"], r["val"], r["test"]) for r in tables.splits.collect()}
    assert splits["python", "Total"] == (36, 12, 12) and splits["unseen", "a"] == (16, 4, 0)
    assert {(r["config"], r["split"]): (r["n"], r["truncated"]) for r in tables.truncated.collect()}[
        "unseen", "test"] == (30, 0)
    done = tables.iterations.collect()
    assert tables.metrics.filter("variant <> 'plain'").isEmpty()
    assert len(done) == 4 and all(0 < r["iterations"] <= r["max_iterations"] for r in done)


def test_standard_configs_and_weights(samples):
    assert [c.label for c in standard_configs()] == ["all", "java", "python", "unseen"]
    assert len(STANDARD) == 13 and len({(e.name, e.language, e.ai) for e in STANDARD}) == 13
    assert standard_configs({"a": {"test_size": 1}})[-1].config == {"a": {"test_size": 1}}
    with pytest.raises(ValueError):
        run_report(samples, standard_configs(), ModelOptions(weights={"text": 0.5, "tree": 0.6}))


def test_variants_stand_in_one_table(samples):
    variants = {"a": ModelOptions(models=("text",)), "b": ModelOptions(models=("tree",), use_scaler=True),
                "c": ModelOptions(models=("text",), text_uses_tree=True)}
    rows = run_tables(samples, [RunConfig("all", 0.2, 0.2)], variants).metrics.collect()
    assert {(r["variant"], r["model"], r["split"]) for r in rows} == {
        (v, m, s) for v, m in (("a", "text"), ("b", "tree"), ("c", "text")) for s in ("val", "test")}


def test_a_repeated_run_replaces_its_own_rows_only(samples, tmp_path, monkeypatch):
    results, options = str(tmp_path / "results"), ModelOptions(models=("tree",))
    configs = [RunConfig("python", 0.2, 0.2, language="python"), RunConfig("java", 0.2, 0.2, language="java")]
    put = runs._put

    def killed(df, config, variant, path):
        if config == "java":
            raise RuntimeError("killed")
        put(df, config, variant, path)

    monkeypatch.setattr(runs, "_put", killed)
    with pytest.raises(RuntimeError):
        run_tables(samples, configs, options, results=results)
    monkeypatch.setattr(runs, "_put", put)
    files = lambda config: {p.name for p in (tmp_path / "results" / "predictions").glob(
        f"config={config}/**/*.parquet")}
    kept = files("python")
    assert kept and not files("java")
    tables = run_tables(samples, configs[1:], options, results=results)
    assert files("python") == kept and files("java")
    assert {(r["config"], r["split"]) for r in tables.metrics.collect()} == {
        (c, s) for c in ("python", "java") for s in ("val", "test")}
    first = files("java")
    run_tables(samples, configs[1:], options, results=results)
    assert files("java") and files("java").isdisjoint(first) and files("python") == kept

import pytest
from pyspark.sql import functions as F

from scribeprint.functions.labels import enforce, label_from_number, split_rejects
from scribeprint.operators import trees
from scribeprint.sources import catalog, readers, sinks
from scribeprint.sources.catalog import Entry


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "java" / "alpha"
    (folder / "inner").mkdir(parents=True)
    (folder / "0_made by AI.java").write_bytes("a\r\nb\rc\té".encode())
    (folder / "1_ hand+100%.java").write_bytes(b"class A {}\n")
    (folder / "inner" / "1_x.java").write_text("not read")
    csv = tmp_path / "python" / "beta.csv"
    csv.parent.mkdir()
    csv.write_bytes(
        'id,label,note,code\n'
        '1,lm,n,"x = ""1""\r\n\ty"\n'
        '2,human,"a,b","def f():\n    pass"\n'
        '3,odd,n,\n'
        '4,odd,n,NA\n'
        '5,human,n,null\n'
        '6,human,n," lead, \\ trail "\n'.encode())
    (tmp_path / "python" / "gamma.jsonl").write_text(
        '{"code": "a\\tb\\r\\n", "label": 1, "x": {"y": 2}}\n{"label": 0.0, "code": "b"}\n'
        '{"code": "c", "label": true}\n', encoding="utf-8")
    return str(tmp_path)


def pairs(df):
    return sorted((r["code"], r["label"]) for r in df.collect())


def test_folder(spark, root):
    df = enforce(readers.read_folder(spark, f"{root}/java/alpha", "java"))
    assert pairs(df) == [("a\nb\nc\té", 1), ("class A {}\n", 0)]
    assert sorted(r[0] for r in df.select("sample_id").collect()) == [
        "0_made by AI.java", "1_ hand+100%.java"]


def test_folder_rejects_other_prefixes(spark, root):
    with open(f"{root}/java/alpha/2_bad.java", "w") as f:
        f.write("x")
    df = readers.read_folder(spark, f"{root}/java/alpha", "java")
    with pytest.raises(Exception, match="label not known: 2"):
        enforce(df).count()
    good, bad = split_rejects(df)
    assert good.count() == 2
    assert [r["reject"] for r in bad.collect()] == ["label not known: 2"]


def test_csv(spark, root):
    df = readers.read_csv(spark, f"{root}/python/beta.csv", "python")
    assert pairs(enforce(df)) == [(" lead, \\ trail ", 0), ("def f():\n    pass", 0),
                                  ('x = "1"\n    y', 1)]
    raw = readers.read_csv(spark, f"{root}/python/beta.csv", "python", clean=False)
    assert ('x = "1"\r\n\ty', 1) in pairs(raw)


def test_csv_bad_label_stops_the_job(spark, tmp_path):
    (tmp_path / "b.csv").write_text("code,label\nx,LM\n")
    with pytest.raises(Exception, match="label not known: LM"):
        enforce(readers.read_csv(spark, str(tmp_path / "b.csv"), "python")).collect()


def test_jsonl(spark, root):
    df = readers.read_jsonl(spark, f"{root}/python/gamma.jsonl", "python")
    assert pairs(enforce(df)) == [("a\tb\r\n", 1), ("b", 0), ("c", 1)]


def test_jsonl_rejects(spark, tmp_path):
    lines = ['{"code": "a", "label": "1"}', "", "nope", '{"code": "a", "label": 2}',
             '{"label": 1}', '{"code": "a"}', '{"code": "ok", "label": 1e0}']
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + "\n")
    df = readers.read_jsonl(spark, str(tmp_path / "r.jsonl"), "python")
    good, bad = split_rejects(df)
    assert pairs(good) == [("ok", 1)]
    assert sorted(r["reject"] for r in bad.collect()) == [
        "label not known: 1", "label not known: 2", "label not known: none", "no code",
        "not a JSON object", "not a JSON object"]
    with pytest.raises(Exception):
        enforce(df).collect()
    with pytest.raises(ValueError):
        enforce(df, "ignore")


def test_numbers_are_compared_as_values(spark):
    given = ["0", "1", "1.0", "-0.0", "true", "false", "2", "x", "0.5", None]
    df = spark.createDataFrame([(g,) for g in given], "t string")
    found = [r[0] for r in df.select(label_from_number(F.col("t"))).collect()]
    assert found == [0, 1, 1, 0, 1, 0, None, None, None, None]


ENTRIES = [Entry("alpha", "java", "m1", "alpha"), Entry("beta", "python", "m1", "beta.csv"),
           Entry("gamma", "python", "m2", "gamma.jsonl"),
           Entry("gone", "python", "m1", "missing.csv")]


def test_catalog_reads_only_what_is_selected(spark, root):
    config = {"alpha": {}, "beta": {}, "gamma": {}}
    samples = catalog.load_samples(spark, ENTRIES, root, config=config)
    counts = {tuple(r)[:3]: r["count"] for r in
              samples.groupBy("dataset", "language", "ai").count().collect()}
    assert counts == {("alpha", "java", "m1"): 2, ("beta", "python", "m1"): 3,
                      ("gamma", "python", "m2"): 3}
    assert samples.select("sample_id").distinct().count() == 8
    assert catalog.load_samples(spark, ENTRIES, root, language="java").count() == 2
    with pytest.raises(ValueError):
        catalog.load_samples(spark, ENTRIES, root, name="Alpha")
    with pytest.raises(ValueError):
        catalog.load_samples(spark, [ENTRIES[0]] * 2, root)


def test_stored_samples_prune_partitions(spark, root, tmp_path):
    samples = catalog.load_samples(spark, ENTRIES[:3], root)
    stored = sinks.write_samples(samples, str(tmp_path / "stored"))
    assert sorted(map(tuple, stored.select("sample_id", "code", "label").collect())) == sorted(
        map(tuple, samples.select("sample_id", "code", "label").collect()))
    plan = stored.filter("dataset = 'beta'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan


def test_report_sink_replaces(spark, tmp_path):
    path = str(tmp_path / "report")
    for n in (3, 1):
        sinks.write_report(spark.range(n), path)
    assert spark.read.json(path).count() == 1


def test_lines_of_any_length(spark):
    big = spark.range(1).select(F.lit("a").alias("sample_id"), F.concat(
        F.lit('{"label": 1, "code": "'), F.repeat(F.lit("x"), 25_000_000), F.lit('"}')).alias("value"))
    row = readers.parse_json_lines(big, "python").select(F.length("code"), "label", "reject").first()
    assert tuple(row) == (25_000_000, 1, None)


def test_csv_that_may_be_split(spark, tmp_path):
    (tmp_path / "t.csv").write_text("code,label\na,lm\n,human\nb,human\n")
    rows = readers.read_csv(spark, str(tmp_path / "t.csv"), "python", multi_line=False)
    assert sorted(map(tuple, rows.select("code", "label").collect())) == [("a", 1), ("b", 0)]


def test_a_manifest_opens_no_file(spark, tmp_path):
    for k, name in enumerate(("0_a.java", "1_b c.java", "x_d.java")):
        (tmp_path / name).write_text("code " * (k + 1))
    got = {r["sample_id"]: r for r in readers.folder_manifest(spark, str(tmp_path), "java").collect()}
    assert {n: (r["label"], r["n_bytes"]) for n, r in got.items()} == {
        "0_a.java": (1, 5), "1_b c.java": (0, 10), "x_d.java": (None, 15)}
    assert got["x_d.java"]["reject"] and "content" not in readers.folder_manifest(
        spark, str(tmp_path), "java")._jdf.queryExecution().executedPlan().toString()


def test_files_are_packed_into_tasks_by_bytes(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"0_{k}.java").write_text("x" * (100 * k))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 100)
    try:
        sizes = readers.read_folder(spark, str(tmp_path), "java").groupBy(F.spark_partition_id()).agg(
            F.sum(F.length("code")).alias("n")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(sizes) > 8 and max(r["n"] for r in sizes) <= 20_000


def test_stored_nodes_and_texts_meet_without_an_exchange(spark, tmp_path):
    samples = spark.createDataFrame([(f"s{k}", "java", f"f({k}) {{ a[{k}] }}") for k in range(50)],
                                    "sample_id string, language string, code string")
    nodes = sinks.write_bucketed(trees.nodes_from_code(samples), str(tmp_path / "nodes"), 4)
    texts = sinks.write_bucketed(samples.select("sample_id", "code"), str(tmp_path / "texts"), 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made, whole in ((trees.node_text(nodes, texts), trees.node_text(trees.nodes_from_code(samples), samples)),
                            (trees.serialise_tokens(nodes, texts), trees.represent(samples, include_tokens=True)),
                            (trees.serialise_tree(nodes), trees.represent(samples))):
            assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, made.collect())) == sorted(map(tuple, whole.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_report_that_fails_leaves_the_last_one(spark, tmp_path):
    path = str(tmp_path / "report")
    sinks.write_report(spark.range(3).toDF("n"), path)
    sinks.write_report(spark.range(4).toDF("n"), path)
    broken = spark.range(2).select(F.when(F.col("id") > 0, F.raise_error(F.lit("broken")).cast("long")).alias("n"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_report(broken, path)
    assert spark.read.json(path).count() == 4

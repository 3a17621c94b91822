"""What the findings of round 3 were about: no sort of tokens, no work file by file on the driver, whole node tables."""

import random

import pytest

from scribeprint.operators import nesting, trees
from scribeprint.plans import queries
from scribeprint.schema import NODES
from scribeprint.sources import readers, sinks

CODE = "sample_id string, language string, code string"


def programs(spark, n=60):
    rng = random.Random(5)
    parts = ["(", ")", "[", "]", "{", "}", " ", "\n", "if", "x1", "3.5", '"a b"', '"', "é", "漢", "+"]
    rows = [(f"c{k}", rng.choice(["python", "java"]), "".join(rng.choices(parts, k=rng.randrange(0, 200)))) for k in range(n)]
    return spark.createDataFrame([*rows, ("e", "java", ""), ("w", "java", " "), ("n", "java", None), (None, "java", "(a)")], CODE)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tokens", [False, True])
def test_trees_of_code_hold_no_rows_of_tokens(spark, tokens):
    plan = plan_of(trees.represent(programs(spark), include_tokens=tokens))
    assert "Generate" not in plan and plan.count("Window ") == 1 and plan.count("Exchange") == 1


def test_packed_trees_equal_those_of_node_rows(spark):
    df = programs(spark)
    flat = trees.serialise_tree(trees.nodes_from_code(df))
    assert sorted(map(repr, trees.represent(df).collect())) == sorted(map(repr, flat.collect()))
    named = df.filter("sample_id is not null")
    for atomic in (trees.ATOMIC_TYPES, ("block",)):
        rows = trees.serialise_tokens(trees.nodes_from_code(named), named, atomic)
        packed = trees.serialise_tokens(trees.packed_from_code(named), named, atomic)
        assert sorted(map(repr, packed.collect())) == sorted(map(repr, rows.collect()))
    full = trees.serialise_tokens(trees.nodes_from_code(df, texts=True))
    assert sorted(map(repr, trees.represent(df, include_tokens=True).collect())) == sorted(map(repr, full.collect()))


@pytest.mark.parametrize("size", [1, 50, 1 << 18])
def test_slices_do_not_change_nodes(spark, size, monkeypatch):
    df = programs(spark)
    import pyarrow as pa
    from scribeprint.functions.tokens import code_tokens
    from pyspark.sql import functions as F
    table = df.filter("language = 'java' and code is not null").select("sample_id", F.lit("program").alias("root"), code_tokens(
        F.col("code"), "java", True).alias("tokens"), "code").toArrow().combine_chunks()
    node = pa.struct([(f.name, pa.string() if f.name == "type" else pa.int32()) for f in NODES.fields[2:]] + [
        ("text", pa.string())])
    schema = pa.schema([("sample_id", pa.string()), ("nodes", pa.list_(node))])
    whole = pa.Table.from_batches(nesting.packed_nodes(table.to_batches(), schema)).to_pylist()
    monkeypatch.setattr(nesting, "SLICE", size)
    assert pa.Table.from_batches(nesting.packed_nodes(table.to_batches(), schema)).to_pylist() == whole


def test_two_programs_of_one_id_stop(spark):
    df = spark.createDataFrame([("p", "java", "(a"), ("p", "java", "b)")], CODE)
    with pytest.raises(Exception, match="two texts have the id p"):
        trees.represent(df).collect()


def test_nodes_from_code_gives_every_node(spark, tmp_path):
    spark.createDataFrame([(1, "a the b"), (2, None)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    found = queries.nodes_from_code(spark, str(tmp_path))
    assert found.columns == NODES.names and [r["type"] for r in found.orderBy("pre").collect()] == [
        "program", "identifier", "parenthesized", "(", "identifier"]


def test_a_folder_is_written_by_tasks(spark, tmp_path):
    path = str(tmp_path / "files")
    files = spark.createDataFrame([("1_a.html", "é\nb"), ("0_c.html", ""), ("1_b.html", "x"), ("1_b.html", "y"), ("", "z")],
                                  "name string, value string")
    queries._write_folder(files, path)
    assert [p.name for p in tmp_path.iterdir()] == ["files"]  # no folder for each file, to be moved by the driver
    got = {r["sample_id"]: r["code"] for r in readers.read_folder(spark, path, "html").collect()}
    assert got == {"1_a.html": "é\nb\n", "0_c.html": "\n", "1_b.html": "x\ny\n"}


def test_buckets_follow_the_partitions_of_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_dir", lambda _: str(tmp_path))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert queries._buckets(spark) == 16
        df = programs(spark)
        nodes = queries._bucketed(spark, trees.packed_from_code(df, tasks=16), "nodes", True)
        texts = queries._bucketed(spark, df.select("sample_id", "code"), "texts")
        tree = trees.serialise_tokens(nodes, texts)
        assert "Exchange hashpartitioning" not in plan_of(tree)
        want = trees.represent(df.filter("sample_id is not null"), include_tokens=True)
        assert sorted(map(repr, tree.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

"""What the findings of round 3 on blocks were about: no rows of tokens, and none of nodes but those that go over blocks."""

import random

from scribeprint.operators import blocks, trees
from scribeprint.session import stored

CODE = "sample_id string, language string, code string"


def programs(spark, n=40):
    rng = random.Random(9)
    parts = ["(", ")", "[", "]", "{", "}", " ", "if", "x1", '"a b"', "é", "+", "<p>", "</p>"]
    rows = [(f"c{k}", rng.choice(["python", "java"]), "".join(rng.choices(parts, k=rng.randrange(0, 150)))) for k in range(n)]
    return spark.createDataFrame([*rows, ("e", "java", ""), ("w", "java", " "), ("n", "java", None), (None, "java", "(a)")], CODE)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_digests_of_packed_nodes_are_those_of_rows(spark):
    df = programs(spark)
    want = sorted(map(repr, trees.node_digest(trees.nodes_from_code(df)).collect()))
    assert sorted(map(repr, trees.node_digest(trees.packed_from_code(df)).collect())) == want
    for pieces in (1, 3, 200):
        packed = blocks.packed_from_code(df, piece_tokens=2, block_pieces=pieces)
        assert sorted(map(repr, trees.node_digest(packed).collect())) == want


def test_what_blocks_know_is_made_without_sorting_tokens(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(blocks, "stored", lambda df, name: plans.append(plan_of(df)) or stored(df, name))
    blocks.nodes_from_markup(programs(spark), piece_tokens=4, block_pieces=2)
    local = plans[0]
    assert "Window" not in local and "Sort " not in local and local.count("Generate") == 1

"""What the findings of round 4 were about: what blocks and pooling store and move."""

import random

import numpy as np
import pyarrow as pa
import pytest

from scribeprint.operators import blocks, nesting, pooling, trees, vectors
from scribeprint.session import stored

CODE = "sample_id string, language string, code string"


def programs(spark, n=30, length=150):
    rng = random.Random(11)
    parts = ["(", ")", "[", "]", "{", "}", " ", "if", "x1", '"a b"', "é", "+", "2.5", "漢"]
    rows = [(f"c{k}", rng.choice(["python", "java"]), "".join(rng.choices(parts, k=rng.randrange(0, length)))) for k in range(n)]
    return spark.createDataFrame([*rows, ("e", "java", ""), ("w", "java", " "), ("n", "java", None), (None, "java", "(a)")], CODE)


def test_nodes_are_stored_and_moved_as_few_bytes(spark, monkeypatch):
    made = []
    monkeypatch.setattr(blocks, "stored", lambda df, name: made.append((name, stored(df, name))) or made[-1][1])
    text = "".join(f"name{k % 7}(a{k % 5}, {k}) + [b];\n" for k in range(2000))
    df = spark.createDataFrame([("a", "java", text)], CODE)
    packed = blocks.packed_from_code(df, piece_tokens=64, block_pieces=4)
    known = dict(made)["block-nodes"]
    n, size = known.selectExpr("sum(n_kept)", "sum(length(nodes))").first()
    assert n > 20000 and size < 4 * n
    plan = trees.node_digest(packed)._jdf.queryExecution().optimizedPlan().toString()
    assert "lines#" not in plan  # lines are written where they are hashed, and are not moved
    want = trees.node_digest(trees.nodes_from_code(df)).collect()
    assert trees.node_digest(packed).collect() == want


@pytest.mark.parametrize("near", [-1, 60, 1 << 20])
def test_texts_are_moved_only_if_long(spark, monkeypatch, near):
    df = programs(spark)
    want = sorted(map(repr, trees.node_digest(trees.nodes_from_code(df)).collect()))
    plans = []
    monkeypatch.setattr(blocks, "NEAR_BYTES", near, raising=False)
    monkeypatch.setattr(blocks, "stored", lambda d, name: plans.append(
        d._jdf.queryExecution().optimizedPlan().toString()) or stored(d, name))
    packed = blocks.packed_from_code(df, piece_tokens=2, block_pieces=3)
    assert "Union" in plans[0] and plans[0].count("RepartitionByExpression") == 1
    assert sorted(map(repr, trees.node_digest(packed).collect())) == want
    assert sorted(map(repr, trees.unpacked(packed).collect())) == sorted(map(repr, trees.nodes_from_code(df).collect()))


@pytest.mark.parametrize("top", [1, 1 << 6, 1 << 14, 1 << 30, 1 << 40])
def test_numbers_and_types_come_back_from_their_bytes(top):
    rng = np.random.default_rng(top)
    sizes = np.array([0, 3, 0, 200, 1, 0])
    columns = [rng.integers(-top, top, sizes.sum()) for _ in range(3)]
    types = pa.array([None if x == 0 else f"t{x}" for x in rng.integers(0, 9, sizes.sum()).tolist()], pa.string())
    found, kinds = nesting._decoded(*((c := nesting._coded(sizes, columns, types))[0], sizes, c[1], 3))
    assert all(map(np.array_equal, found, columns)) and kinds.equals(types)
    assert np.array_equal(nesting._sums(nesting._steps(columns[0], sizes), sizes), columns[0])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_pooling_deals_tokens_once_and_joins_no_means(spark, monkeypatch, kind):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    table = {w: [rng.randrange(-50, 50) / 4 for _ in range(5)] for w in words[:50]}
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for k in range(60)]
    rows += [(3, "w1"), (None, "w2 w3"), (100, "w4 " * 700 + "w5"), (101, None), (102, ""), (103, "w59 none")]
    monkeypatch.setattr(vectors, "GROUP_BYTES", 300)
    for name, size in (("BUNDLE", 25), ("TOKENS", 30), ("SAMPLES", 4)):
        monkeypatch.setattr(pooling, name, size, raising=False)
    known = spark.createDataFrame(list(table.items()), f"token string, vector array<{kind}>")
    found = vectors.pool_tokens(spark.createDataFrame(rows, "sample_id long, code string").repartition(3), known)
    got = found.collect()
    assert sorted(repr(r["sample_id"]) for r in got) == sorted(repr(k) for k, _ in rows)
    for r in got:
        own = [table[w] for k, t in rows if k == r["sample_id"] for w in (t or "").split() if w in table]
        want = [sum(c) / len(own) for c in zip(*own)] if own else None
        assert r["embedding"] == (want and pytest.approx(want))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "LeftOuter" not in plan


def test_vectors_move_compressed_in_bundles():
    rng = np.random.default_rng(2)
    table = rng.normal(size=(3000, 16)).astype(np.float32)
    batch = pa.record_batch([pa.array(np.arange(3000) % 3, pa.int32()), pa.array([f"t{k}" for k in range(3000)]),
                             pa.array(list(table), pa.list_(pa.float32()))], names=["__of", "token", "vector"])
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary())
    schema = pa.schema(list(zip(("__of", "words", "n", "size", "vectors"), kinds)))
    made = pa.Table.from_batches(pooling.bundled_vectors(iter([batch]), schema))
    assert made.num_rows == 3 and sum(map(len, made["vectors"].to_pylist())) < 0.95 * table.nbytes
    samples = pa.table({"g": [0, 0], "id": ["a", "b"], "words": ["t0 t3", "other"], "counts": [bytes([1, 3]), bytes([1])]})
    means = pooling.pooled_means(samples, made.slice(0, 1), pa.schema([("id", pa.string()), ("embedding", pa.list_(pa.float64()))]))
    assert means["embedding"].to_pylist()[0] == pytest.approx(((table[0] + 3 * table[3].astype(float)) / 4).tolist())
    assert means["embedding"].to_pylist()[1] is None

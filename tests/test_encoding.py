import random

from scribeprint.operators import encoding as E


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "sample_id int, code string")


def test_vocabulary_order(spark):
    df = table(spark, ["b a c a", "b. É_1 x" + "y" * 300])
    vocabulary = dict(map(tuple, E.build_vocabulary(df, 4).collect()))
    assert vocabulary == {"a": 4, "b": 5, ".": 6, "c": 7}
    every = dict(map(tuple, E.build_vocabulary(df, 10**6).collect()))
    assert "x" + "y" * 300 in every and len(every) == 6


def test_short_exact_and_long_rows(spark):
    texts = ["", "a", "a b a", "a b a b", "zzz a b a b a", None]
    df = table(spark, texts)
    vocabulary = spark.createDataFrame([("a", 4), ("b", 5)], "token string, token_id int")
    rows = {r["sample_id"]: r for r in E.encode_tokens(df, vocabulary, 6).collect()}
    ids = {k: r["input_ids"] for k, r in rows.items()}
    assert ids == {0: [0, 2, 1, 1, 1, 1], 1: [0, 4, 2, 1, 1, 1], 2: [0, 4, 5, 4, 2, 1],
                   3: [0, 4, 5, 4, 5, 2], 4: [0, 3, 4, 5, 4, 2], 5: [0, 2, 1, 1, 1, 1]}
    for r in rows.values():
        assert r["attention_mask"] == [int(i != 1) for i in r["input_ids"]]
    # An exact fit (row 3) counts as truncated, as a longer one does.
    counted = E.truncated_count(df.selectExpr("*", "'train' AS split"), "split", 6).first()
    assert tuple(counted) == ("train", 6, 2)


def test_label_stays_with_its_row(spark, tmp_path):
    table(spark, ["a b"]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    vocabulary = spark.createDataFrame([("a", 4)], "token string, token_id int")
    encoded = E.encode_tokens(df.selectExpr("*", "1 AS label"), vocabulary, keep=["label"])
    assert encoded.columns == ["sample_id", "input_ids", "attention_mask", "label"]
    assert encoded.first()["label"] == 1


def test_vocabulary_by_sketch(spark):
    """Exact for any number of tracked tokens: where the bound fails, all tokens are counted."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(3_000)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(3_000)], k=400)) for _ in range(60)] + ["", None]
    df = table(spark, texts)
    expected = list(map(tuple, E.build_vocabulary(df, 20).collect()))
    for tracked in (64, 1024, 1 << 16):
        assert list(map(tuple, E.build_vocabulary_by_sketch(df, 20, tracked=tracked).collect())) == expected
    assert E.build_vocabulary_by_sketch(df, 10**6).count() == E.build_vocabulary(df, 10**6).count()

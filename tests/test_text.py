import random

from pyspark.sql import functions as F

from scribeprint.functions import text


def test_clean_text_keeps_a_lone_cr(spark):
    df = spark.createDataFrame([("a\r\nb\tc\rd\r\r\n",)], "code string")
    assert df.select(text.clean_text(F.col("code"))).first()[0] == "a\nb    c\rd\r\n"
    assert df.select(text.universal_newlines(F.col("code"))).first()[0] == "a\nb\tc\nd\n\n"


def test_substring_count_equals_str_count(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abé( .*") for _ in range(rng.randrange(40))),) for _ in range(300)]
    needles = ["a", "aa", "aba", "é", "éé", "(", " ", ".", "*", "a.", "(a", ".*"]
    df = spark.createDataFrame(rows, "s string")
    found = df.select("s", *[text.substring_count(F.col("s"), n).alias(f"c{i}")
                             for i, n in enumerate(needles)]).collect()
    for row in found:
        assert list(row[1:]) == [row[0].count(n) for n in needles], row[0]


def test_words_equal_str_split(spark):
    gaps = [c for c in map(chr, range(0x110000)) if c.isspace()] + ["  \n "]
    assert len(gaps) > 20
    rows = [(f"{g}x{g}y z{g}",) for g in gaps] + [("",), ("   ",), ("a\u200bb",), ("a\ufeffb",), ("a\u180eb",)]
    for (s, found) in spark.createDataFrame(rows, "s string").select(
            "s", text.words(F.col("s"))).collect():
        assert found == s.split(), repr(s)


def test_repetition_ratio(spark):
    df = spark.createDataFrame([("a b a c",), ("",), ("x x x",)], "s string")
    rows = df.select(text.repetition_ratio(text.words(F.col("s")))).collect()
    assert [r[0] for r in rows] == [4 / 3, 0.0, 3.0]

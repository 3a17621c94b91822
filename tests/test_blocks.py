"""Trees and features by blocks equal those of whole texts, wherever blocks end."""

import random

import pytest

from scribeprint.functions.structure import FEATURES, with_structural_features
from scribeprint.operators import blocks, trees

NODE = ["sample_id", "node_id", "pre", "post", "depth", "n_children", "type", "start_byte", "end_byte"]


def texts():
    rng = random.Random(7)
    code = ["(", ")", "[", "]", "{", "}", " ", "\n", "if", "x1", "3.5", '"a b"', "'", '"', "#c\n", "//d\n", "é", "漢", "+"]
    markup = ["<p>", "</p>", "<div class='x'>", "</div>", "<br>", "<!-- a <b> -->", "text é ", "<", "<!DOCTYPE html>", "<a/>"]
    rows = [(f"c{k}", rng.choice(["python", "java"]), "".join(rng.choices(code, k=rng.randrange(0, 220)))) for k in range(40)]
    rows += [(f"m{k}", "java", "".join(rng.choices(markup, k=rng.randrange(0, 150)))) for k in range(30)]
    deep = [("d1", "python", "(" * 300 + ")" * 300), ("d2", "python", ")" * 90 + "([" * 90), ("d3", "java", "()" * 200),
            ("d4", "java", "(" + "[]" * 150), ("d5", "java", "))((" * 60), ("e1", "java", ""), ("e2", "python", "x"),
            (None, "java", "(a)"), ("n1", "java", None)]
    return rows + deep


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(texts(), "sample_id string, language string, code string").repartition(3).cache()


def rows(df):
    return sorted((tuple(r) for r in df.select(*NODE).collect()), key=repr)


# About one block a text, seven, and 64 or more.
@pytest.mark.parametrize("piece_tokens, block_pieces", [(128, 128), (4, 8), (1, 3), (1, 1)])
def test_node_tables(samples, piece_tokens, block_pieces):
    sizes = {"piece_tokens": piece_tokens, "block_pieces": block_pieces}
    code = samples.filter("sample_id is null or sample_id not like 'm%'")
    assert rows(blocks.nodes_from_code(code, **sizes)) == rows(trees.nodes_from_code(code))
    assert rows(blocks.nodes_from_markup(samples, **sizes)) == rows(trees.nodes_from_markup(samples))


def test_two_texts_of_one_id_stop_the_job(spark):
    df = spark.createDataFrame([("a", "java", "(x"), ("a", "java", "y)")], "sample_id string, language string, code string")
    with pytest.raises(Exception, match="two texts have the id a"):
        blocks.nodes_from_code(df)


@pytest.mark.parametrize("block_chars", [1, 7, 40, 1 << 16])
def test_features(spark, block_chars):
    rng = random.Random(8)
    voc = ["(", ")", "if_statement", "elif_clause", "for_statement", "while_statement", "if_statement::left", "list", "x(",
           "))", "true", "parameter_list", "é", " ", "\x1d", "identifier"]
    rows_ = [(f"t{k}", " ".join(rng.choices(voc, k=rng.randrange(0, 90)))) for k in range(50)]
    rows_ += [("gaps", " \n\t  ( ( if_statement  \n"), ("empty", ""), ("null", None), ("edge", "x " * 500 + "(" * 50)]
    df = spark.createDataFrame(rows_, "sample_id string, code string")
    whole = with_structural_features(df.filter("code is not null")).select("sample_id", *FEATURES)
    found = blocks.structural_features(df, block_chars=block_chars)
    assert found.columns == whole.columns
    clean = lambda d: {r["sample_id"]: tuple(round(float(x), 9) for x in r[1:]) for r in d.collect()}
    assert clean(found) == clean(whole)

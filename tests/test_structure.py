import random

import pytest

from scribeprint.functions import structure as S


def plain(s):
    """The features of one string, by loops over its characters and words."""
    level = top = 0
    for c in s:
        level += {"(": 1, ")": -1}.get(c, 0)
        top = max(top, level)
    words = s.split()
    level, seen_if, seen_loop, ifs, loops = 0, False, False, 0, 0
    for w in words:
        if w in "()":
            level += 1 if w == "(" else -1
        if w in S.IF_TOKENS:
            ifs += seen_if and level > 1
            seen_if = True
        if w in S.LOOP_TOKENS:
            loops += seen_loop and level > 1
            seen_loop = True
    named = {**S.NODE_GROUPS, **S.LITERAL_NAMES, **S.STYLE_NAMES}
    result = {k: sum(s.count(n) for n in names) for k, names in named.items()}
    opens, spaces = s.count("("), s.count(" ")
    result |= {"max_depth": top, "n_chars": len(s), "open_parens": opens, "spaces": spaces,
               "branching": spaces / opens if opens else 0.0, "nested_ifs": ifs,
               "nested_loops": loops,
               "repetition": len(words) / len(set(words)) if words else 0.0}
    return result


def texts():
    rng = random.Random(7)
    names = sorted({n for g in (S.NODE_GROUPS, S.LITERAL_NAMES, S.STYLE_NAMES)
                    for names in g.values() for n in names})
    pool = [*names, *S.IF_TOKENS, *S.LOOP_TOKENS, "(", ")", "(", ")", "é", "x::left", "))", "((",
            "try_statementry_statement", "listlist", "_", "(if_statement"]
    made = [rng.choice([" ", "  ", "\n", " "]).join(rng.choices(pool, k=rng.randrange(60)))
            for _ in range(200)]
    return ["", " ", "(", ")(", "(()", ")))(((", "if_statement", *made]


def test_features_equal_plain_python(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "code string")
    rows = S.with_structural_features(df).collect()
    assert len(S.FEATURES) == 23
    for row in rows:
        expected = plain(row["code"])
        assert {f: row[f] for f in S.FEATURES} == expected, repr(row["code"])


def test_other_names_and_order(spark):
    df = spark.createDataFrame([("the cat and the dog",)], "code string")
    groups = {name: ("the",) for name in S.NODE_GROUPS}
    row = S.with_structural_features(df, groups=groups)
    assert row.columns == ["code", *S.FEATURES]
    assert row.first()["control_flow"] == 2
    vector = row.select(S.feature_array()).first()[0]
    assert len(vector) == 23 and vector[1] == 2.0
    with pytest.raises(ValueError):
        S.with_structural_features(df, groups={"control_flow": ("two words",)})


def test_one_narrow_pass_without_python(spark):
    df = spark.createDataFrame([("a",)], "code string")
    plan = S.with_structural_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("[\\s") == 1  # the text is split into words once

import random

import pytest

from scribeprint.operators import trees
from scribeprint.schema import NODES


class Node:
    def __init__(self, kind, start, end=None, children=()):
        self.kind, self.start, self.end, self.children = kind, start, end, list(children)


def rows_of(sample_id, root):
    """Node-table rows of a tree, by a walk with a stack of its own."""
    rows, stack, pre, post = [], [(root, 0, False)], 0, 0
    ranks = {}
    while stack:
        node, depth, done = stack.pop()
        if done:
            rows.append((sample_id, ranks[id(node)], ranks[id(node)], post, depth,
                         len(node.children), node.kind, node.start, node.end))
            post += 1
            continue
        ranks[id(node)] = pre
        pre += 1
        stack.append((node, depth, True))
        stack.extend((c, depth + 1, False) for c in reversed(node.children))
    return rows


def nested_form(node):
    if not node.children:
        return node.kind
    return f"({node.kind} {' '.join(nested_form(c) for c in node.children)})"


def with_texts(node, data, atomic):
    if not node.children or node.kind in atomic:
        return [data[node.start:node.end].decode()]
    inner = [t for c in node.children for t in with_texts(c, data, atomic)]
    return [f"{node.kind}::left", *inner, f"{node.kind}::right"]


def random_tree(rng, data, start, end, depth=0):
    """A node over whole characters of ``data`` with children in order."""
    kind = rng.choice(["identifier", "string_literal", "block", "call", "number_literal"])
    node = Node(kind, start, end)
    if depth < 6 and end - start > 2 and rng.random() < 0.8:
        cuts = sorted(rng.sample([i for i in range(start, end + 1)
                                  if i == len(data) or data[i] & 0xC0 != 0x80],
                                 k=min(4, 2)))
        cuts = [start, *[c for c in cuts if start <= c <= end], end]
        node.children = [random_tree(rng, data, a, b, depth + 1)
                         for a, b in zip(cuts, cuts[1:]) if a < b]
        if len(node.children) == 1 and node.children[0].end - node.children[0].start == end - start:
            node.children = node.children[0].children
    return node


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(3)
    samples, rows, roots = [], [], {}
    for i in range(60):
        code = "".join(rng.choice("ab é漢(\n") for _ in range(rng.randrange(3, 60)))
        data = code.encode()
        root = random_tree(rng, data, 0, len(data))
        samples.append((f"s{i}", code))
        rows += rows_of(f"s{i}", root)
        roots[f"s{i}"] = (root, data)
    return (spark.createDataFrame(rows, NODES).repartition(5),
            spark.createDataFrame(samples, "sample_id string, code string"), roots)


def test_serialisations_of_any_node_table(forest):
    nodes, samples, roots = forest
    for sid, tree in trees.serialise_tree(nodes).collect():
        assert tree == nested_form(roots[sid][0])
    for atomic in (trees.ATOMIC_TYPES, ()):
        for sid, tree in trees.serialise_tokens(nodes, samples, atomic).collect():
            assert tree == " ".join(with_texts(*roots[sid], atomic))


def test_without_atomic_inner_nodes_marks_balance(forest):
    nodes, samples, _ = forest
    for _, tree in trees.serialise_tokens(nodes, samples, ()).collect():
        assert tree.count("::left") == tree.count("::right")


def test_node_text_and_types(forest):
    nodes, samples, roots = forest
    spans = {(r["sample_id"], r["node_id"]): (r["start_byte"], r["end_byte"])
             for r in nodes.collect()}
    texts = trees.node_text(nodes, samples).collect()
    assert len(texts) == len(spans)
    for sid, node_id, text in texts:
        start, end = spans[sid, node_id]
        assert text == roots[sid][1][start:end].decode()

    def preorder(node):
        return [node.kind] + [k for c in node.children for k in preorder(c)]

    for sid, types in trees.node_types(nodes).collect():
        assert types == preorder(roots[sid][0])


def test_single_node(spark):
    nodes = spark.createDataFrame([("a", 0, 0, 0, 0, 0, "module", 0, 2)], NODES)
    samples = spark.createDataFrame([("a", "é")], "sample_id string, code string")
    assert trees.serialise_tree(nodes).first()["tree"] == "module"
    assert trees.serialise_tokens(nodes, samples).first()["tree"] == "é"


VOID = {"br", "img"}


def parse(html):
    """Markup by a stack, with the same rules: names do not matter, strays are dropped."""
    import re
    root = Node("document", 0, len(html.encode()))
    stack, at = [root], 0
    for t in re.findall(r"(?s)<!--.*?-->|<[^>]*>|[^<]+|<", html):
        size = len(t.encode())
        name = re.match(r"<([A-Za-z][A-Za-z0-9:-]*)", t)
        if t.startswith("</"):
            if len(stack) > 1:
                stack.pop().end = at + size
        else:
            kind = ("comment" if t.startswith("<!--") else "declaration" if t.startswith(("<!", "<?"))
                    else name.group(1).lower() if name else "text")
            node = Node(kind, at, at + size)
            stack[-1].children.append(node)
            if name and kind not in VOID and not t.endswith("/>"):
                node.end = root.end  # until it is closed
                stack.append(node)
        at += size
    return root


def test_markup_equals_a_stack_parser(spark):
    rng = random.Random(11)
    pieces = ["<p>", "</p>", "<B class='x'>", "</b>", "<br>", "<img/>", "text", "é漢", "<!-- <p> -->",
              "<!DOCTYPE html>", "<", " < 3", "</", "\n", "<?x?>", "<a\nhref='y'>", "<p/>"]
    pages = [("e", ""), ("t", "only text"), ("c", "</p></p>"), ("o", "<p><p><p>"),
             *[(f"r{i}", "".join(rng.choices(pieces, k=rng.randrange(1, 60)))) for i in range(150)]]
    df = spark.createDataFrame(pages, "sample_id string, code string")
    got = {}
    for row in trees.nodes_from_markup(df).collect():
        got.setdefault(row["sample_id"], []).append(tuple(row))
    for sid, html in pages:
        assert sorted(got[sid]) == sorted(rows_of(sid, parse(html))), html


def test_ten_thousand_levels(spark):
    html = "<p>" * 10_000 + "x"
    df = spark.createDataFrame([("deep", html)], "sample_id string, code string")
    nodes = trees.nodes_from_markup(df)
    stats = trees.tree_stats(nodes, {"p": ["p"]}).first()
    assert (stats["n_nodes"], stats["max_depth"], stats["n_leaves"], stats["n_p"]) == (
        10_002, 10_001, 1, 10_000)
    tree = trees.serialise_tree(nodes).first()["tree"]
    assert tree == "(document " + "(p " * 10_000 + "text" + ")" * 10_001


PYTHON = "def f(n):\n    # é\n    return [n, 'a(b', 2.5, 10]\n"
JAVA = 'class A { /* c( */ int x = f(1, "q\\"(");'


def test_code_by_language(spark):
    df = spark.createDataFrame([("p", PYTHON, "python"), ("j", JAVA, "java")],
                               "sample_id string, code string, language string")
    flat = dict(map(tuple, trees.represent(df).collect()))
    assert flat["p"] == ("(module def identifier (parenthesized ( identifier )) : comment return "
                         "(bracketed [ identifier , string , float , integer ]))")
    assert flat["j"] == ("(program class identifier (block { comment int identifier = identifier "
                         "(parenthesized ( integer , string )) ;))")
    full = dict(map(tuple, trees.represent(df, include_tokens=True).collect()))
    assert full["j"] == ('program::left class A block::left { /* c( */ int x = f parenthesized::left '
                         '( 1 , "q\\"(" ) parenthesized::right ; block::right program::right')


def test_unknown_language(spark):
    df = spark.createDataFrame([("a", "x", "cobol"), ("b", "x", "java")],
                               "sample_id string, code string, language string")
    with pytest.raises(Exception, match="no token rules for language: cobol"):
        trees.represent(df).collect()
    assert [r["sample_id"] for r in trees.represent(df, policy="drop").collect()] == ["b"]


def test_one_exchange_of_compact_rows(spark, tmp_path):
    spark.createDataFrame([("a", "<p>x</p>")], "sample_id string, code string").write.parquet(
        str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    stats = trees.tree_stats(trees.nodes_from_markup(pages), {"p": ["p"]})
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("regexp_extract_all") == 1


def test_long_tokens_do_not_overflow_the_matcher(spark):
    quoted = '"' + "\\n" * 200_000 + '"'
    df = spark.createDataFrame([("a", quoted, "python")],
                               "sample_id string, code string, language string")
    assert trees.represent(df).first()["tree"] == "(module string)"


def test_two_texts_of_one_id_stop(spark):
    df = spark.createDataFrame([("p", "<p>a</p>"), ("p", "<b><i>c</i></b>")], "sample_id string, code string")
    with pytest.raises(Exception, match="two texts have the id p"):
        trees.serialise_tree(trees.nodes_from_markup(df)).collect()


def test_texts_and_not_tokens_are_exchanged(spark, tmp_path):
    text = "<div>" + "<p>some words here</p>" * 50 + "</div>"
    spark.createDataFrame([(f"p{i}", text) for i in range(200)], "sample_id string, code string").write.parquet(
        str(tmp_path / "pages"))
    df = spark.read.parquet(str(tmp_path / "pages"))
    plan = trees.nodes_from_markup(df)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert plan.count("Exchange") == 1 and "regexp_extract_all" not in below

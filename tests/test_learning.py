import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from scribeprint.functions import scoring
from scribeprint.operators import learning, vectors
from scribeprint.sources import sinks


def data(spark, n=300, dims=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * [1.0, 3.0, 0.5][:dims]
    y = (x @ [1.5, -0.4, 2.0][:dims] + rng.normal(size=n) > 1.0).astype(int)
    rows = [(f"s{i}", [float(v) for v in x[i]], int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id string, v array<double>, label int")
    return df.withColumn("features", vectors.as_vector(F.col("v"))), x, y


def newton(x, y, c=1.0):
    """Minimum of |w|^2 / 2 + c * sum of balanced losses, intercept free."""
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    a = np.hstack([x, np.ones((len(y), 1))])
    free = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        gradient = c * a.T @ (weight * (p - y)) + free @ w
        hessian = c * (a * (weight * p * (1 - p))[:, None]).T @ a + free
        w -= np.linalg.solve(hessian, gradient)
    return w


@pytest.mark.parametrize("c", [1.0, 0.1])
def test_classifier_has_the_sum_form_optimum(spark, c):
    df, x, y = data(spark)
    model = learning.fit_classifier(df, c=c, tol=1e-10)
    expected = newton(x, y, c)
    np.testing.assert_allclose(model.coefficients.toArray(), expected[:-1], atol=1e-4)
    np.testing.assert_allclose(model.intercept, expected[-1], atol=1e-4)


def test_probabilities_and_known_weights(spark):
    df, _, _ = data(spark)
    model = learning.fit_classifier(df)
    own = scoring.linear_probability(F.col("v"), list(model.coefficients), model.intercept)
    rows = learning.predict(model, df.withColumn("own", own), ["sample_id", "own"]).collect()
    assert len(rows) == 300
    for r in rows:
        assert abs(r["p0"] + r["p1"] - 1) < 1e-12 and abs(r["p1"] - r["own"]) < 1e-9
        assert r["y_pred"] == int(r["p1"] > r["p0"])


def test_no_training_rows(spark):
    df, _, _ = data(spark, 10)
    with pytest.raises(ValueError):
        learning.fit_classifier(df.filter("label = 7"))


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    assert {r["label"]: r["weight"] for r in learning.class_weights(df).collect()} == {
        0: 8 / 12, 1: 2.0}
    rows = learning.with_balanced_weights(df).distinct().collect()
    assert {r["label"]: r["weight"] for r in rows} == {0: 8 / 12, 1: 2.0}
    one = learning.with_balanced_weights(df.filter("label = 1")).first()
    assert one["weight"] == 1.0


def test_scaler_uses_the_population_deviation_of_train(spark):
    rows = [([1.0, 5.0],), ([3.0, 5.0],)]
    train = spark.createDataFrame(rows, "v array<float>")
    scaler = vectors.fit_scaler(train, "v")
    test = spark.createDataFrame([([5.0, 6.0],), ([1.0, 5.0],)], "v array<float>")
    assert [r["z"] for r in vectors.apply_scaler(test, scaler, "v", "z").collect()] == [
        [3.0, 1.0], [-1.0, 0.0]]
    single = vectors.fit_scaler(train.limit(1), "v")
    assert single.first()["deviation"] == [1.0, 1.0]


def test_mean_pool(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [7.0, 7.0])],
                               "id string, vec array<float>")
    assert dict(map(tuple, vectors.mean_pool(df, "id", "vec").collect())) == {
        "a": [2.0, 4.0], "b": [7.0, 7.0]}


def test_softmax(spark):
    df = spark.createDataFrame([(1000.0, 1000.0), (0.0, 2.0), (5.0, -800.0)], "a double, b double")
    p0, p1 = scoring.softmax([F.col("a"), F.col("b")])
    rows = df.select(p0, p1, scoring.argmax2(F.col("a"), F.col("b"))).collect()
    assert tuple(rows[0]) == (0.5, 0.5, 0)
    assert rows[1][2] == 1 and abs(rows[1][1] - 1 / (1 + np.exp(-2))) < 1e-12
    assert tuple(rows[2]) == (1.0, 0.0, 0)


def scores(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, model string, p0 double, p1 double")


def test_blend(spark):
    rows = [("a", "text", 0.3, 0.7), ("a", "tree", 0.9, 0.1), ("b", "text", 0.5, 0.5),
            ("b", "tree", 0.5, 0.5), ("a", "other", 0.0, 1.0)]
    weights = {"text": 0.6, "tree": 0.4}
    blended = {r["sample_id"]: r for r in learning.blend_scores(scores(spark, rows), weights).collect()}
    assert blended["a"]["p0"] == 0.3 * 0.6 + 0.9 * 0.4 and blended["a"]["y_pred"] == 0
    assert blended["b"]["y_pred"] == 0  # a tie
    with pytest.raises(ValueError):
        learning.blend_scores(scores(spark, rows), {"text": 0.6, "tree": 0.5})


def test_blend_checks_the_pairing(spark):
    weights = {"text": 0.6, "tree": 0.4}
    lone = [("a", "text", 0.3, 0.7), ("a", "tree", 0.9, 0.1), ("b", "text", 0.5, 0.5)]
    with pytest.raises(Exception, match="sample b"):
        learning.blend_scores(scores(spark, lone), weights).collect()
    assert learning.blend_scores(scores(spark, lone), weights, "drop").count() == 1
    twice = lone[:2] + [("a", "text", 0.2, 0.8)]
    with pytest.raises(Exception, match="sample a"):
        learning.blend_scores(scores(spark, twice), weights, "drop").collect()


def test_stored_text_classifier_scores_the_same(spark, tmp_path):
    rows = [(f"s{i}", f"for x in {'range' if i % 2 else 'list'}({i})", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_id string, code string, label int")
    terms = learning.stored_terms(df, ["sample_id", "label"])
    model = learning.fit_terms_classifier(terms)
    sinks.save_model(model, str(tmp_path / "model"))
    again = sinks.load_model(str(tmp_path / "model"))
    assert isinstance(again, PipelineModel)
    a, b = (sorted(map(tuple, learning.predict(m, terms, ["sample_id", "label"]).collect()))
            for m in (model, again))
    assert a == b
    assert all(r[4] == r[1] for r in a)


def test_the_end_of_a_long_text_counts(spark):
    rows = [(f"s{i}", "same " * 5000 + ("left" if i % 2 else "right"), i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "sample_id string, code string, label int")
    terms = learning.stored_terms(df, ["sample_id", "label"])
    model = learning.fit_terms_classifier(terms)
    found = learning.predict(model, terms, ["sample_id", "label"]).collect()
    assert all(r["y_pred"] == r["label"] for r in found)


def test_gradient_is_zero_at_the_optimum_only(spark):
    df, _, _ = data(spark)
    gradient = learning.objective_gradient(learning.fit_classifier(df, tol=1e-10), df)
    assert gradient.count() == 4 and gradient.filter("abs(gradient) > 1e-3").isEmpty()
    early = learning.objective_gradient(learning.fit_classifier(df, max_iterations=1), df)
    assert not early.filter("abs(gradient) > 1e-1").isEmpty()


def test_embedding_is_a_weighted_mean_of_token_marks(spark):
    rows = [("a", "x y"), ("b", "x y x y"), ("c", "z"), ("d", "")]
    counted = vectors.hash_tokens(spark.createDataFrame(rows, "sample_id string, code string"), ["sample_id"])
    fitted = vectors.text_embedder().fit(counted)
    got = {r["sample_id"]: r["embedding"]
           for r in vectors.embed_text(counted, fitted, ["sample_id"]).collect()}
    assert got["a"] == got["b"] and len(got["a"]) == 256 and sum(got["d"]) == 0
    assert sum(v > 0 for v in got["a"]) == 2


@pytest.mark.parametrize("hashing", ["md5", "xxhash64"])
def test_sparse_entries(spark, hashing):
    rows = [("a", "x y x"), ("b", ""), ("c", "z"), ("n", None)]
    df = spark.createDataFrame(rows, "sample_id string, code string")
    counted = vectors.hash_tokens(df.fillna(""), ["sample_id"], digits=3, hashing=hashing)
    got = {r["sample_id"]: r for r in counted.select(
        "sample_id", "counts", vectors.sparse_entries("counts").alias("e")).collect()}
    for r in got.values():
        assert [(e["dim"], e["value"]) for e in r["e"]] == list(zip(r["counts"].indices, r["counts"].values))
    assert sorted(e["value"] for e in got["a"]["e"]) == [1.0, 2.0] and got["b"]["e"] == []


def test_token_vectors_are_trained_and_pooled(spark):
    texts = [f"cat dog pet {k % 3}" if k % 2 else f"sun moon sky {k % 3}" for k in range(200)]
    df = spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(texts)] + [("none", "unseen"), ("null", None)],
                               "sample_id string, code string")
    train = lambda: {r["token"]: r["vector"] for r in vectors.train_token_vectors(
        df.repartition(5), size=8, iterations=2).collect()}
    table = train()
    assert table == train() and set(table) == {"cat", "dog", "pet", "sun", "moon", "sky", "0", "1", "2"}
    stored = spark.createDataFrame(list(table.items()), "token string, vector array<float>")
    got = {r["sample_id"]: r["embedding"] for r in vectors.pool_tokens(df, stored).collect()}
    for k in (0, 1, 77):
        own = [table[t] for t in texts[k].split()]
        assert got[f"s{k}"] == pytest.approx([sum(x) / 4 for x in zip(*own)])
    assert got["none"] is None and got["null"] is None and len(got) == 202


def test_assembled_vector(spark):
    df = spark.createDataFrame([([1.0, 2.0], 3, 4.5)], "embedding array<float>, x int, y double")
    assert vectors.assemble(df, features=["x", "y"]).first()["features"] == [
        1.0, 2.0, 3.0, 4.5]

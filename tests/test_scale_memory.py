"""What a task gets does not follow the size of the table, and entries of vectors are not read from text."""

from scribeprint.operators import blocks, vectors


def test_words_are_counted_in_more_tasks_when_there_are_more(spark, monkeypatch):
    df = spark.createDataFrame([(f"t{k}", "a b c " * 20) for k in range(40)], "sample_id string, code string")
    monkeypatch.setattr(blocks, "TASK_BYTES", 300, raising=False)
    plan = blocks.structural_features(df, block_chars=50)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample_id" in plan and ", 16)" in plan


def test_entries_are_read_from_the_vector(spark):
    df = vectors.hash_tokens(spark.createDataFrame([("a", "x y x")], "sample_id string, code string"), ["sample_id"])
    plan = df.select(vectors.sparse_entries("counts"))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan

import json

from pyspark.sql import functions as F

from scribeprint.functions.structure import FEATURES
from scribeprint.streaming import features as S


def test_stream_equals_batch_and_takes_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"code": f"if_statement ( {'x ' * i} call )", "label": i % 2} for i in range(20)]

    def add(name, rows):
        (folder / name).write_text("\n".join(map(json.dumps, rows)) + "\n\nbroken\n")

    weights = [0.01 * i for i in range(len(FEATURES))]

    def run():
        samples = S.read_jsonl_stream(spark, str(folder), "python")
        scored = S.score_samples(samples, weights, -0.5)
        S.write_stream(scored, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)

    add("a.jsonl", lines[:12])
    run()
    add("b.jsonl", lines[12:])
    run()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = S.score_samples(spark.createDataFrame(
        [(r["code"], r["label"]) for r in lines], "code string, label int"), weights, -0.5)
    columns = ["code", "label", *FEATURES, "y_pred"]
    assert streamed.count() == 20  # blank and broken lines are dropped
    assert sorted(map(tuple, streamed.select(columns).collect())) == sorted(
        map(tuple, batch.select(columns).collect()))
    assert streamed.filter(F.abs(F.col("p0") + F.col("p1") - 1) > 1e-12).count() == 0

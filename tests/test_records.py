"""Split files: the same rows and ids whatever the blocks and tasks."""

import random

import pytest
from pyspark.sql import functions as F

from scribeprint.sources.readers import read_csv, read_jsonl
from scribeprint.sources.records import csv_rows, file_lines, numbered_lines


def field(text):
    return '"' + text.replace('"', '""') + '"'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three files: long quoted fields over many blocks, short rows, and one with CRLF ends."""
    rng = random.Random(6)
    path = tmp_path_factory.mktemp("split csv")
    voc = ["a", "b", '"', '""', "\n", "\n\n", ",", "é", "x y", " "]
    for name, most in (("a+1.csv", 60), ("b.csv", 3)):
        lines = ["id,code,label,more"]
        for k in range(300):
            code = "".join(rng.choices(voc, k=rng.randrange(1, most)))
            lines.append(f'{k},{field(code)},{rng.choice(["lm", "human"])},"{k % 7}"')
            lines += [""] * (k % 50 == 0)
        (path / name).write_text("\n".join(lines) + "\n", encoding="utf-8", newline="")
    big = "id,code,label,more\n0," + field("line\n" * 5_000 + '"') + ",lm,\n1,z,human,\n"
    (path / "c.csv").write_text(big, newline="")
    return str(path)


def by_blocks(spark, size, run):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", [150, 1_000, 1 << 27])
def test_rows_are_those_of_the_whole_file_reader(spark, folder, size):
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(folder)
    expected = sorted(map(repr, (tuple(r) for r in whole.collect())))
    found = by_blocks(spark, size, lambda: csv_rows(spark, folder).drop("file", "line").collect())
    assert sorted(map(repr, map(tuple, found))) == expected and len(expected) == 602


def test_ids_do_not_depend_on_tasks(spark, folder):
    runs = [by_blocks(spark, size, lambda: sorted(
        (r["sample_id"], r["code"]) for r in read_csv(spark, folder, "java", clean=False).collect()))
        for size in (100, 2_000, 1 << 27)]
    assert runs[0] == runs[1] == runs[2]
    ids = [r[0] for r in runs[0]]
    assert len(set(ids)) == len(ids) and any(i.startswith("a+1.csv:") for i in ids)


def test_a_file_is_read_by_many_tasks(spark, folder):
    tasks = by_blocks(spark, 1_000, lambda: file_lines(spark, folder, "\n").rdd.getNumPartitions())
    assert tasks > 20


@pytest.mark.parametrize("size", [64, 1 << 27])
def test_crlf_and_headers(spark, tmp_path, size):
    (tmp_path / "w.csv").write_bytes(b'label,code\r\nlm,"a\r\nb"\r\n\r\nhuman,"x ""y"""\r\nhuman,NA\r\nlm,z')
    (tmp_path / "v.csv").write_bytes(b'label,code\r\nbot,q\r\n')
    rows = by_blocks(spark, size, lambda: sorted(
        (r["sample_id"], r["code"], r["label"], r["reject"] is None) for r in read_csv(
            spark, str(tmp_path), "java").collect()))
    assert rows == [("v.csv:1", "q", None, False), ("w.csv:1", "a\nb", 1, True), ("w.csv:4", 'x "y"', 0, True),
                    ("w.csv:6", "z", 1, True)]


def test_lines_without_quoted_breaks(spark, tmp_path):
    (tmp_path / "s.csv").write_text("code,label\n" + "".join(f"c{k},lm\n" for k in range(200)))
    rows = by_blocks(spark, 100, lambda: read_csv(spark, str(tmp_path / "s.csv"), "java", multi_line=False).collect())
    assert sorted(r["sample_id"] for r in rows) == sorted(f"s.csv:{k + 1}" for k in range(200))


def test_an_open_quote_and_empty_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text('code,label\nx,lm\n"never closed,lm\ny,lm\n')
    rows = csv_rows(spark, str(tmp_path)).collect()
    assert sorted(r["line"] for r in rows) == [1, 2]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "only.csv").write_text("code,label\n")
    assert read_csv(spark, str(tmp_path / "h"), "java").count() == 0


@pytest.mark.parametrize("size", [50, 1 << 27])
def test_json_lines(spark, tmp_path, size):
    (tmp_path / "x.jsonl").write_text("".join('{"code": "c%d", "label": %d}\n' % (k, k % 2) for k in range(100)) + "\n")
    rows = by_blocks(spark, size, lambda: read_jsonl(spark, str(tmp_path / "x.jsonl"), "java").collect())
    assert {(r["sample_id"], r["code"]) for r in rows} == {
        *((f"x.jsonl:{k}", f"c{k}") for k in range(100)), ("x.jsonl:100", None)}


def test_a_scan_that_is_cut_otherwise_stops(spark, folder):
    lines = file_lines(spark, folder)
    moved = lines.withColumn("at", F.col("at") + F.lit(1))
    from scribeprint.sources import records
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.min("at").alias("first_at"))
    with pytest.raises(Exception, match="cut into blocks in another way"):
        records._placed(moved, blocks.withColumn("line_0", F.lit(0))).collect()
    assert numbered_lines(lines).count() == lines.count()

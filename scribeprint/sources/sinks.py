"""Sinks: samples, reports, models."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_samples(samples: DataFrame, path: str) -> DataFrame:
    """Store samples by dataset and language, so that later filters on them skip files. Rows are
    laid out first, so that a dataset has as many files as its size asks for."""
    laid_out = samples.repartitionByRange("dataset", "language", F.xxhash64("sample_id"))
    laid_out.write.mode("overwrite").partitionBy("dataset", "language").parquet(path)
    return read_samples(samples.sparkSession, path, samples)


def read_samples(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """Stored samples. With ``like`` the column types of that table are used as they are."""
    reader = spark.read.schema(like.schema) if like is not None else spark.read
    return reader.parquet(path)


def write_bucketed(df: DataFrame, path: str, buckets: int, by: str = "sample_id", name: str | None = None,
                   laid_out: bool = False) -> DataFrame:
    """Store a table in ``buckets`` by the hash of ``by``, each sorted by it, and read it back.

    Tables of one number of buckets meet without an exchange: joins, groups and windows by that column start where
    the rows are. For node tables and the texts they belong to, which every serialisation reads together. The table is
    known to the session's catalog as ``name`` (or one of its own), its files are in ``path``. A table that is
    ``laid_out`` has been dealt to so many partitions by that column already, and is not moved again.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    dealt = df if laid_out else df.repartition(buckets, by)
    (dealt.write.bucketBy(buckets, by).sortBy(by).option("path", path).format("parquet")
     .saveAsTable(name))
    return df.sparkSession.table(name)


def write_named(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: a file in the folder ``path`` for each run of equal names in the rows ``name, value``, which
    holds its values, each with a line feed behind it. Gives the number of files. A file is put in place when it is
    complete, so a task that runs twice leaves the same files."""
    files, root = fs.FileSystem.from_uri(path)
    part, n, last, out = f"{root}/.{uuid.uuid4().hex}", 0, None, None
    files.create_dir(root)

    def done() -> None:
        if out:
            out.close()
            files.move(part, f"{root}/{last}")

    for batch in batches:
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != last:
                done()
                out, last, n = files.open_output_stream(part), name, n + 1
            out.write(f"{value}\n".encode())
    done()
    yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])


def _swapped(spark: SparkSession, path: str, write) -> None:
    """``write`` to a new folder, then put it in the place of the old one: a run that fails leaves the old result."""
    made = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    write(made)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (made, path))
    store = new.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(old, True)
    if not store.rename(new, old):
        raise OSError(f"{made} is complete, but could not be moved to {path}")


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """Store a report (a table of a bounded number of rows), replacing the last one once it is complete."""
    _swapped(report.sparkSession, path, lambda made: report.write.format(fmt).save(made))


def save_model(model: PipelineModel, path: str) -> None:
    """Store a fitted pipeline, replacing the last one once it is complete."""
    _swapped(SparkSession.getActiveSession(), path, lambda made: model.write().save(made))


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

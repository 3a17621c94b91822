"""Session helpers: a local session for tests and benchmarks, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "scribeprint", memory: str = "12g",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session. On a cluster the session comes from spark-submit instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scribeprint-"))
    return spark.sparkContext.getCheckpointDir()


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if it is not installed for them."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{known}:{root}".strip(":")


def size_tasks(df: DataFrame, text: str, size: int) -> int:
    """How many parts of about ``size`` bytes the texts make, and as many as there are cores at least. Texts are measured
    when this is called."""
    total = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-total // size))


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """A number for each of ``n`` partitions, which Spark's hash puts there: so many keys make tasks of one key each."""
    numbers = spark.range(n * (n.bit_length() + 10)).select(F.col("id").cast("int").alias("k"))
    found = numbers.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()
    own = {r["p"]: r["k"] for r in found}
    return [own.get(p, -1 - p) for p in range(n)]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a table of its own in the shared folder."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Intermediate tables, written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scribeprint.session import importable, shared_dir


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own for every call, so that a later call never replaces files still in use."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder.

    The table cuts the lineage: a lost executor costs its running tasks only.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name. ``run`` gets the batches and the Arrow schema to answer in.

    Columns are numbered on the way, since the call itself takes names with dots and backticks apart.
    """
    importable(df.sparkSession)
    numbered = T.StructType([T.StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema.fields)])
    arrow = to_arrow_schema(numbered)
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.mapInArrow(lambda batches: run(batches, arrow), numbered).toDF(*schema.names)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    importable(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes not to clash with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that the operator is about to add; an added column replaces an old one."""
    low = {n.lower() for n in names}
    return df.select(*[c for c in quoted(df) if c[1:-1].replace("``", "`").lower() not in low])


def quoted(df: DataFrame) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def as_text(column: str | Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))

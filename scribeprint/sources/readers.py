"""Readers of labelled samples. Each gives ``SAMPLES`` columns plus ``reject``.

``reject`` holds the reason why a row is not usable and is null for good rows;
``functions.labels.enforce`` decides what happens to the bad ones. Row ids come
from the file name, with the line number where a file has many rows, so they are
the same whatever the number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeprint.functions.labels import (label_from_number, label_from_prefix,
                                          label_from_word)
from scribeprint.functions.text import clean_text, universal_newlines
from scribeprint.sources.records import csv_rows, file_lines, numbered_lines, row_id

# Spellings that the usual CSV readers of Python take for "no value".
NA_STRINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


JSON_OPTIONS = {"maxStringLen": str((1 << 31) - 1), "allowSingleQuotes": "false",
                "columnNameOfCorruptRecord": "__broken"}


def _bad_label(given: Column, label: Column) -> Column:
    text = F.concat(F.lit("label not known: "), F.coalesce(given, F.lit("none")))
    return F.when(label.isNull(), text)


def spread(df: DataFrame, tasks: int | None) -> DataFrame:
    """``df`` dealt to so many tasks, if a number is given. For small files with heavy rows: a file of one row group is
    one task otherwise. It moves all rows, so large tables should be read as they are cut."""
    return df.repartition(tasks) if tasks else df


def _file_name(column: str) -> Column:
    return F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))


def read_folder(spark: SparkSession, path: str, language: str) -> DataFrame:
    """One sample per file, labelled by the file name's prefix; sub-folders are not read.

    Spark packs files into tasks by their bytes (``spark.sql.files.maxPartitionBytes``, with
    ``spark.sql.files.openCostInBytes`` added for each file), so many small files make one task. It passes
    over files of no bytes.
    """
    files = spark.read.text(path, wholetext=True).select(
        _file_name("_metadata.file_name").alias("sample_id"), universal_newlines(F.col("value")).alias("code"))
    return label_files(files, language)


def folder_manifest(spark: SparkSession, path: str, language: str) -> DataFrame:
    """``sample_id, label, language, reject, n_bytes, modified`` of the files of a folder. No file is opened: labels
    are in the names, so what a folder holds, and what of it would be rejected, is known before it is read. Store
    it to list a folder of millions of files once."""
    files = spark.read.format("binaryFile").load(path).select(
        _file_name("_metadata.file_name").alias("sample_id"), F.lit(None).cast("string").alias("code"),
        F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))
    labelled = label_files(files, language, "n_bytes", "modified")
    return labelled.drop("code")


def label_files(files: DataFrame, language: str, *keep: str) -> DataFrame:
    """``sample_id`` (a file name) and ``code``, labelled by the prefix of the name."""
    label = label_from_prefix(F.col("sample_id"))
    prefix = F.substring_index("sample_id", "_", 1)
    return files.select("sample_id", "code", label.alias("label"),
                        F.lit(language).alias("language"), _bad_label(prefix, label).alias("reject"), *keep)


def present(code: Column) -> Column:
    """Whether a cell holds code: not null, and no spelling of "no value"."""
    return code.isNotNull() & ~code.isin(*NA_STRINGS)


def drop_null_code(df: DataFrame, code: str = "code") -> DataFrame:
    """Rows with code. Done before labels are looked at."""
    return df.filter(present(F.col(code)))


def read_csv(spark: SparkSession, path: str, language: str, clean: bool = True,
             multi_line: bool = True) -> DataFrame:
    """Columns ``code`` and ``label`` of a CSV with a header. Rows without code are dropped
    before their label is looked at; all columns are read as text, none is inferred.

    With ``multi_line`` a quoted field may hold line breaks. Files are split either way (see
    ``sources.records``)."""
    raw = csv_rows(spark, path, multi_line).select("file", "line", "code", "label")
    code = clean_text(F.col("code")) if clean else F.col("code")
    label = label_from_word(F.col("label"))
    return drop_null_code(raw).select(
        row_id(path).alias("sample_id"), code.alias("code"),
        label.alias("label"), F.lit(language).alias("language"),
        _bad_label(F.col("label"), label).alias("reject"))


def read_jsonl(spark: SparkSession, path: str, language: str, clean: bool = False) -> DataFrame:
    """One JSON object per line with ``code`` and a numeric ``label``."""
    lines = numbered_lines(file_lines(spark, path)).withColumn("sample_id", row_id(path))
    return parse_json_lines(lines, language, clean)


def parse_json_lines(lines: DataFrame, language: str, clean: bool = False) -> DataFrame:
    """``sample_id`` and ``value`` (one line of JSON). A blank or broken line is a reject.

    Labels are compared as values, so 1.0 and true count as 1; the string "1" does not.
    Lines may be as long as a string can be.
    """
    parsed = lines.withColumn("__v", F.from_json(
        "value", "code string, label variant, __broken string", JSON_OPTIONS))
    given = F.col("__v.label").try_cast("string")
    is_text = F.schema_of_variant("__v.label") == "STRING"
    label = F.when(is_text, F.lit(None)).otherwise(label_from_number(given))
    code = F.col("__v.code")
    broken = F.col("__v").isNull() | F.col("__v.__broken").isNotNull()
    reason = (F.when(broken, F.lit("not a JSON object"))
               .when(code.isNull(), F.lit("no code"))
               .otherwise(_bad_label(given, label)))
    return parsed.select("sample_id", (clean_text(code) if clean else code).alias("code"),
                         label.alias("label"), F.lit(language).alias("language"),
                         reason.alias("reject"))


def read_table(spark: SparkSession, path: str, language: str, id_col: str = "sample_id",
               code_col: str = "code", label_col: str | None = "label",
               language_col: str | None = None) -> DataFrame:
    """A Parquet table with columns of any name. Without a label column the label is null."""
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    bad = _bad_label(label.cast("string"), F.when(label.isin(0, 1), label)) if label_col else (
        F.lit(None).cast("string"))
    return spark.read.parquet(path).select(
        F.col(id_col).cast("string").alias("sample_id"), F.col(code_col).alias("code"),
        label.alias("label"),
        (F.col(language_col) if language_col else F.lit(language)).alias("language"),
        bad.alias("reject"))

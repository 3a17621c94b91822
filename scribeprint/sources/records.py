"""Lines and CSV records of split files, numbered the same way however files are cut into tasks.

Spark cuts a file into blocks of bytes and reads each block's lines in order, but does not say where in the
file they are. Two small passes tell it:

- **Numbers.** Lines are counted per block, and running sums of the counts over the blocks of a file give every
  block the number of its first line. A line's own number is that plus its place in the block.
- **Records.** A line break inside of quotes does not end a record. Quotes are counted per block as well: the
  running sum's parity tells whether a block starts inside of a quoted field, and so where its first record begins.
  Lines before that place end a record of an earlier block; they are joined to it, the others are put
  together in their block. So a file is read by as many tasks as it has blocks.

Files follow RFC 4180: quotes stand around a field, and twice inside of one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CUT_ANEW = "files were cut into blocks in another way while they were read; read them again: "


def file_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """``file, block, at, value``: ``block`` is the first byte of a line's block, ``at`` rises with the lines of one."""
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")


def _in_file(last: int) -> Window:
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, last)


def _before(c: Column) -> Column:
    return F.coalesce(F.sum(c).over(_in_file(-1)), F.lit(0))


def _placed(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """``lines`` with their ``line`` number and what ``blocks`` says of their block.

    Both sides come from scans of the same files. Should the second one cut or deal the files otherwise,
    some line falls out of its block's range, and that stops the job.
    """
    joined = lines.join(blocks.withColumnsRenamed({"file": "file_", "block": "block_"}),
                        (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_")), "left")
    place = F.col("at") - F.col("first_at")
    known = place.between(0, F.col("n_lines") - 1)
    line = F.when(known, F.col("line_0") + place).otherwise(
        F.raise_error(F.concat(F.lit(_CUT_ANEW), F.col("file"))).cast("bigint"))
    return joined.withColumn("line", line).drop("file_", "block_", "first_at", "n_lines", "line_0")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``file, line, value``: line numbers from 0 in each file. Only counts are shuffled."""
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.min("at").alias("first_at"))
    blocks = counts.withColumn("line_0", _before(F.col("n_lines")))
    return _placed(lines, blocks).select("file", "line", "value")


def quoted_records(lines: DataFrame, quote: str = '"') -> DataFrame:
    """``file, line, value``: records that may hold line breaks inside of quotes; ``line`` is that of their start.

    Lines are moved once, by block, for the running parity inside of it. A quote that is never closed makes the rest
    of its file one record.
    """
    lines = lines.withColumn("odd", (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))) % 2)
    is_odd = F.col("odd") == 1
    blocks = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("at").alias("first_at"), F.sum("odd").alias("n_odd"),
        F.min(F.when(is_odd, F.col("at"))).alias("first_odd"), F.max(F.when(is_odd, F.col("at"))).alias("last_odd"))
    blocks = blocks.withColumns({"line_0": _before(F.col("n_lines")), "inside": _before(F.col("n_odd")) % 2})
    number = lambda at: F.col("line_0") + F.col(at) - F.col("first_at")
    ends_inside = (F.col("inside") + F.col("n_odd")) % 2 == 1
    blocks = (blocks.withColumn("opened", F.when(ends_inside, number("last_odd")))  # null without an odd line
                    .withColumn("owner", F.last("opened", ignorenulls=True).over(_in_file(-1)))
                    .withColumn("begins", F.when(F.col("inside") == 0, F.col("line_0")).otherwise(number("first_odd") + 1))
                    .drop("opened", "n_odd", "first_odd", "last_odd"))
    placed = _placed(lines, blocks)
    later = (F.col("inside") == 1) & (F.col("begins").isNull() | (F.col("line") < F.col("begins")))
    listed = F.array_sort(F.collect_list(F.struct("line", "value")))
    tails = placed.filter(later).groupBy(F.col("file").alias("file_"), "owner").agg(listed.alias("tail"))
    reading = Window.partitionBy("file", "block").orderBy("line")
    odd_before = F.coalesce(F.sum("odd").over(reading.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = placed.filter(~later).withColumn("starts", odd_before % 2 == 0).withColumn(
        "start", F.max(F.when(F.col("starts"), F.col("line"))).over(
            reading.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    records = own.groupBy("file", "block", "start").agg(listed.alias("head"))
    joined = records.join(tails, (F.col("file") == F.col("file_")) & (F.col("start") == F.col("owner")), "left")
    parts = F.concat("head", F.coalesce("tail", F.array().cast("array<struct<line:bigint,value:string>>")))
    return joined.select("file", F.col("start").alias("line"),
                         F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))


def csv_rows(spark: SparkSession, path: str, multi_line: bool = True, quote: str = '"') -> DataFrame:
    """``file, line`` and the columns of CSV files with a header, all as text.

    The names are those of the first file's header; every file has one. Blank lines are no records.
    """
    options = {"header": "true", "multiLine": str(multi_line).lower(), "quote": quote, "escape": quote,
               "encoding": "UTF-8"}
    names = spark.read.options(**options).csv(path).columns
    lines = file_lines(spark, path, "\n")
    records = quoted_records(lines, quote) if multi_line else numbered_lines(lines)
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    text = F.regexp_replace("value", r"\r\z", "")  # lines may end with CRLF
    parsed = F.from_csv(text, F.lit(ddl), {"quote": quote, "escape": quote})
    # The header is line 0 of each file.
    return records.filter((F.col("line") > 0) & (F.trim(text) != "")).select(
        "file", "line", parsed.alias("r")).select("file", "line", "r.*")


def row_id(path: str) -> Column:
    """``name:line``, with the file's place below ``path``, or its own name."""
    file = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    below = F.regexp_replace(file, "^.*" + re.escape(path.rstrip("/")) + "/?", "")
    name = F.when(below == "", F.element_at(F.split(file, "/"), -1)).otherwise(below)
    return F.concat_ws(":", name, F.col("line").cast("string"))

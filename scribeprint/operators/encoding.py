"""Fixed-length token ids and masks, with a vocabulary counted from the corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribeprint.operators.lookup import lookup_join

# Ids of the marks, and the length most text models take.
BEGIN, PAD, END, UNKNOWN = 0, 1, 2, 3
FIRST_TOKEN_ID = 4
MAX_LENGTH = 512

TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def text_tokens(text: Column) -> Column:
    """Runs of letters and digits, and single other characters that are not white space."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def build_vocabulary(df: DataFrame, size: int, text: str = "code") -> DataFrame:
    """``token, token_id`` of the ``size`` most frequent tokens; equal counts by token.

    Counts are added up before the shuffle, so a token that is everywhere costs
    one row per task, and only ``size`` rows reach the single sorted list. Tokens may
    have any length, and a vocabulary any size.
    """
    # The outer form: from the inner one Spark would derive a filter that tokenises twice.
    # A text without tokens gives a null.
    counts = (df.select(F.explode_outer(text_tokens(F.col(text))).alias("token"))
                .filter(F.col("token").isNotNull())
                .groupBy("token").agg(F.count("*").alias("n")))
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size)
    order = Window.orderBy(F.desc("n"), F.asc("token"))
    number = F.row_number().over(order) + (FIRST_TOKEN_ID - 1)
    return top.select("token", number.alias("token_id"))


#: Tokens that a task's sketch tracks.
TRACKED = 1 << 17


def build_vocabulary_by_sketch(df: DataFrame, size: int, text: str = "code", tracked: int = TRACKED) -> DataFrame:
    """As ``build_vocabulary``, without moving a count for every distinct token.

    A frequent-items sketch of ``tracked`` tokens per task names candidates, and a second pass counts those exactly.
    A sketch is off by 3.5 / ``tracked`` of all tokens at most, and names what is seen more than twice that often. So
    if the last of the first ``size`` candidates is counted more often, no other token can belong before it, and
    the rows are exact. If not, or if there are too few candidates, all tokens are counted as in
    ``build_vocabulary``. At most ``tracked`` candidates, and no others, come to the driver.
    """
    opened = df.select(F.explode_outer(text_tokens(F.col(text))).alias("token")).filter(F.col("token").isNotNull())
    most = tracked * 3 // 4
    row = opened.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(token, {most}, {tracked})").alias("top")).first()
    names = df.sparkSession.createDataFrame([(t["item"],) for t in row["top"] or []], "token string")
    counts = lookup_join(opened, names, ["token"]).groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size)
    counted = top.agg(F.count("*").alias("rows"), F.min("n").alias("least")).first()
    if counted["rows"] < size or counted["least"] <= 7 * row["n"] / tracked:
        return build_vocabulary(df, size, text)
    number = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("token"))) + (FIRST_TOKEN_ID - 1)
    return top.select("token", number.alias("token_id"))


def pad(ids: Column, max_length: int) -> tuple[Column, Column]:
    """Ids filled up on the right to ``max_length``, and the mask of what is not filling."""
    missing = F.lit(max_length) - F.size(ids)
    return (F.concat(ids, F.array_repeat(F.lit(PAD), missing)),
            F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), missing)))


def encode_tokens(df: DataFrame, vocabulary: DataFrame, max_length: int = MAX_LENGTH,
                  id_col: str = "sample_id", text: str = "code",
                  keep: Sequence[str] = ()) -> DataFrame:
    """``id_col, input_ids, attention_mask`` of every row: begin, token ids, end, filling.
    Columns in ``keep``, such as a label, stay with their row.

    The text is tokenised as a whole and the list is cut to what a row of
    ``max_length`` can hold, so one row sends at most that many tokens on. The
    only shuffle is of those lists; after it, rows are opened, looked up and put
    together again inside the same layout.
    """
    kept = F.slice(text_tokens(F.coalesce(F.col(text), F.lit(""))), 1, max_length - 2)
    own = [id_col, *keep]
    lists = df.select(*own, kept.alias("tokens")).repartition(id_col)
    opened = lists.select(*own, F.posexplode_outer("tokens").alias("pos", "token"))
    found = lookup_join(opened, vocabulary, ["token"], how="left")
    # A row without tokens has one opened row, with no position.
    numbered = F.when(F.col("pos").isNotNull(), F.struct(
        "pos", F.coalesce("token_id", F.lit(UNKNOWN)).alias("token_id")))
    grouped = found.groupBy(*own).agg(F.sort_array(F.collect_list(numbered)).alias("found"))
    ids = F.concat(F.array(F.lit(BEGIN)), F.transform("found", lambda x: x["token_id"]),
                   F.array(F.lit(END)))
    input_ids, mask = pad(F.col("ids"), max_length)
    return (grouped.select(*own, ids.alias("ids"))
                   .select(id_col, input_ids.alias("input_ids"), mask.alias("attention_mask"), *keep))


def mask_length(text: Column, max_length: int = MAX_LENGTH) -> Column:
    """How many ones the mask of a text has, without making the mask."""
    return F.least(F.size(text_tokens(text)) + 2, F.lit(max_length))


def truncated_count(df: DataFrame, by: str = "split", max_length: int = MAX_LENGTH,
                    text: str = "code") -> DataFrame:
    """Rows per group whose mask is full. A text that fits exactly counts as truncated."""
    full = mask_length(F.coalesce(F.col(text), F.lit("")), max_length) == max_length
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(full).alias("truncated"))

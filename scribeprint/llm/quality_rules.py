"""Quality rules on documents and on their hosts.

Rules are counted per document in one projection. Failures are added up by host; a host's failure rates
are shrunk towards those of all hosts by a beta prior that is fitted to the hosts' rates, so that
a host with few documents is not judged by them alone. A host with a rate that is surely too high is
rejected, and its verdict is joined back to its documents.

Only DataFrame expressions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeprint.llm.mixing import BLANKS
from scribeprint.llm.scratch import as_text, free_name, quoted, without, written

SYMBOLS = "#*$%&|<>"
#: Words of a window, and the rules of the base.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 0.30
#: Rules that only count for the host.
MAX_SYMBOLS = 0.10
MAX_DUP_LINES = 0.30
MIN_WORD_CHARS, MAX_WORD_CHARS = 2.0, 20.0
#: A host is rejected if a shrunk rate, less so many standard deviations, is above the limit.
MAX_RATE = 0.50
DEVIATIONS = 2.0
#: Prior documents a host is given: at least and at most, for rates that vary more or less than chance.
MIN_PRIOR, MAX_PRIOR = 2.0, 10_000.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = ("failed_base", "failed_symbols", "failed_lines", "failed_length")
ADDED = (*COUNTS, "base_failed", "kept")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, even where it is used inside of a loop over an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def removed(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def window_hashes(words: Column) -> Column:
    """A hash of each run of ``WINDOW`` words; empty if there are fewer."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                    lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))))


def repeated_words(hashes: Column) -> Column:
    """Words in windows that stand twice or more, from the windows' hashes.

    Equal hashes stand side by side when sorted; every repeated window adds the words by which it
    goes on from the one before it.
    """
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(s, i)["h"] == e["h"], F.lit(False))
        return F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1))

    starts = F.array_sort(F.transform(let(placed, repeated), lambda e: e["i"]))
    begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    counted = F.aggregate(starts, begin, lambda a, i: F.struct(
        i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), counted).otherwise(0).cast("long")


def count_rules(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``COUNTS`` and ``base_failed``. Whole texts are read, null as empty."""
    if text in ADDED:  # it is read under another name, and replaced
        given, text = text, free_name(df, "text_")
        return count_rules(df.withColumnRenamed(given, text), text).drop(text)
    df = without(df, *ADDED)
    own = as_text(text)
    trimmed = F.btrim(own, F.lit(BLANKS))
    names = {n: free_name(df, n) for n in ("words_", "windows_", "lines_")}
    words, windows, lines = (F.col(names[n]) for n in ("words_", "windows_", "lines_"))
    split = (df.withColumn(names["words_"], F.when(trimmed == "", F.array().cast("array<string>"))
                           .otherwise(F.split(trimmed, "[ \\t-\\r]+")))
             .withColumn(names["lines_"], F.filter(F.split(own, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")))
    hashed = split.withColumn("n_words", F.size(words).cast("long")).withColumn(
        names["windows_"], window_hashes(words))
    counted = hashed.withColumns({
        "word_chars": F.length(removed(own, BLANKS)).cast("long"),
        "n_symbols": (F.octet_length(own) - F.octet_length(removed(own, SYMBOLS))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(windows),
    }).drop(*names.values())
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                              | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words")))


def rule_failures() -> dict[str, Column]:
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    return {
        "failed_base": F.col("base_failed"),
        "failed_symbols": F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"),
        "failed_lines": F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
        "failed_length": (mean < MIN_WORD_CHARS) | (mean > MAX_WORD_CHARS),
    }


def judge_hosts(counted: DataFrame, host: str) -> DataFrame:
    """``host, n_docs, rejected`` and for each rule its failures and shrunk rate."""
    failures = rule_failures()
    hosts = counted.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *(F.sum(failures[r].cast("long")).alias(r) for r in RULES))
    rate = {r: F.col(r) / F.col("n_docs") for r in RULES}
    moments = hosts.agg(*(x for r in RULES for x in (
        F.avg(rate[r]).alias(f"mean_{r}"), F.coalesce(F.var_samp(rate[r]), F.lit(0.0)).alias(f"var_{r}"))),
        F.avg(1 / F.col("n_docs")).alias("noise")).first()  # one row
    lows = []
    for r in RULES:
        mean = moments[f"mean_{r}"] or 0.0
        chance = mean * (1 - mean)
        spread = moments[f"var_{r}"] - chance * (moments["noise"] or 0.0)
        prior = min(max(chance / spread - 1, MIN_PRIOR), MAX_PRIOR) if spread > 0 else MAX_PRIOR
        shrunk = (F.col(r) + F.lit(mean * prior)) / (F.col("n_docs") + F.lit(prior))
        low = shrunk - DEVIATIONS * F.sqrt(shrunk * (1 - shrunk) / (F.col("n_docs") + F.lit(prior + 1)))
        hosts = hosts.withColumn(f"rate_{r}", shrunk)
        lows.append(low > MAX_RATE)
    return hosts.withColumn("rejected", reduce(lambda a, b: a | b, lows))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``COUNTS``, ``base_failed`` and ``kept``; without ``text`` unless ``keep_text``.

    ``kept`` is false where the base rules fail or the document's host is rejected.

    Null text counts as empty (no words, so the base fails). A null host is a host like others. Repeated
    rows count as often as they stand. Texts are read whole; an empty table stays empty;
    columns with the names of the result are replaced, others stay.
    """
    counted = count_rules(docs, text)
    if not keep_text and text not in ADDED:
        counted = counted.drop(text)
    counted = written(counted, "quality-rules")
    host_, mark = free_name(counted, "rejected_host_"), free_name(counted, "rejected_")
    # Written, so that its size is known before rows are dealt by host: a hot host would be one task.
    rejected = written(judge_hosts(counted, host).filter("rejected").select(
        F.col("host").alias(host_), F.lit(True).alias(mark)), "rejected-hosts")
    joined = counted.join(rejected, counted[host].eqNullSafe(rejected[host_]), "left")
    kept = ~F.col("base_failed") & F.col(mark).isNull()
    return joined.select(*quoted(counted), kept.alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their own columns. Null and empty texts go, as the base fails; repeated rows
    are kept or not together; an empty table stays empty."""
    judged = quality_rules(docs, **options)
    return judged.filter("kept").select(*quoted(docs))

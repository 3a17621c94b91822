"""Raw documents to a training mix, stage by stage.

Every stage takes all documents that the one before has kept, with any further columns. What a stage does with null
and empty texts, repeated rows, null ids and empty tables is said at the stage; ties are those of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scribeprint.llm import decontamination, mixing, near_dedup, quality_rules, secrets
from scribeprint.llm.scratch import documents, importable, written


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, from hosts that are not rejected.

    Null and empty texts have no words and go. Repeated rows count for their host as often as they stand, and stay or go
    together. Ids are not looked at; a null source is a host like others; an empty table stays empty."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Texts without words all stay, of rows with equal id and text one stays, a null id is never preferred; an
    empty table stays empty."""
    importable(spark)
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts stay, repeated rows stay or go together, ids are not looked at, and with an empty benchmark
    all stay."""
    importable(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts.

    Null and empty texts are as they were, repeated rows are masked alike, ids may be null. ``n_chars`` is counted
    anew."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of: id, source, size, its source's size and target, words taken.

    Null and empty texts have no words and are never taken, repeated rows are documents of their own, a null source is
    the last one, and an empty table gives an empty mix."""
    return mixing.taken_words(docs).filter("taken > 0")


STAGES = [
    ("quality rules", reject_bad),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret scans", hide_secrets),
    ("source mix", mix_sources),
]
#: The secret stage trains its model on the documents, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The catalog: which datasets exist, in which language, by which AI, and where."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeprint.functions.labels import enforce
from scribeprint.sources.readers import read_csv, read_folder, read_jsonl, read_table


@dataclass(frozen=True)
class Entry:
    """One dataset entry. ``name`` may repeat; ``(name, language, ai)`` may not."""

    name: str
    language: str
    ai: str
    path: str
    options: Mapping[str, object] = field(default_factory=dict)


# The standard catalog, as name, language, AI and path below the language's folder.
STANDARD: tuple[Entry, ...] = tuple(Entry(*e) for e in (
    ("gptsniffer", "java", "chatgpt", "gptsniffer"),
    ("humaneval", "java", "gpt_4", "humaneval_chatgpt4_java_merged.csv"),
    ("humaneval", "java", "chatgpt", "humaneval_chatgpt_java_merged.csv"),
    ("humaneval", "java", "gemini_pro", "humaneval_gemini_java_merged.csv"),
    ("humaneval", "python", "gpt_4", "humaneval_chatgpt4_python_merged.csv"),
    ("humaneval", "python", "chatgpt", "humaneval_chatgpt_python_merged.csv"),
    ("humaneval", "python", "gemini_pro", "humaneval_gemini_python_merged.csv"),
    ("mbpp", "python", "gpt_4", "mbpp_chatgpt4_python_merged.csv"),
    ("mbpp", "python", "chatgpt", "mbpp_chatgpt_python_merged.csv"),
    ("mbpp", "python", "gemini_pro", "mbpp_gemini_python_merged.csv"),
    ("codenet", "python", "gemini_flash", "codenet_gemini_python.csv"),
    ("hmcorp", "python", "chatgpt", "hmcorp.jsonl"),
    ("hmcorp", "java", "chatgpt", "hmcorp.jsonl"),
))


def select_entries(catalog: Iterable[Entry], config: Mapping[str, Mapping] | None = None,
                   name: str | None = None, language: str | None = None) -> list[Entry]:
    """The entries a run needs. Paths of the others are never touched."""
    return [e for e in catalog
            if not (config and e.name not in config)
            and (not name or e.name == name) and (not language or e.language == language)]


def read_entry(spark: SparkSession, root: str, entry: Entry) -> DataFrame:
    """One entry, read by the suffix of its path: root/language/path, or an absolute path."""
    path = entry.path if ":/" in entry.path or entry.path.startswith("/") else "/".join(
        [root.rstrip("/"), entry.language, entry.path])
    if path.endswith(".csv"):
        rows = read_csv(spark, path, entry.language, **entry.options)
    elif path.endswith(".jsonl"):
        rows = read_jsonl(spark, path, entry.language, **entry.options)
    elif path.endswith(".parquet"):
        rows = read_table(spark, path, entry.language, **entry.options)
    else:
        rows = read_folder(spark, path, entry.language, **entry.options)
    own = F.concat_ws("/", F.lit(entry.name), F.lit(entry.language), F.lit(entry.ai), "sample_id")
    return rows.select(own.alias("sample_id"), F.lit(entry.name).alias("dataset"), "language",
                       F.lit(entry.ai).alias("ai"), "code", F.col("label").cast("int"), "reject")


def load_samples(spark: SparkSession, catalog: Iterable[Entry], root: str = ".",
                 policy: str = "fail", **filters) -> DataFrame:
    """All samples of the selected entries as one table."""
    entries = select_entries(catalog, **filters)
    if not entries:
        raise ValueError("no catalog entry matches the filters")
    keys = [(e.name, e.language, e.ai) for e in entries]
    if len(set(keys)) < len(keys):
        raise ValueError("catalog entries must differ in name, language or ai")
    parts = [read_entry(spark, root, e) for e in entries]
    return enforce(reduce(DataFrame.unionByName, parts), policy)

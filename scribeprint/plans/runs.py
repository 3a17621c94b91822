"""Whole runs: split, represent, train, predict and report for several configurations."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeprint.functions.structure import FEATURES, with_structural_features
from scribeprint.operators import encoding, evaluation, learning, vectors
from scribeprint.operators.splitting import split_datasets, split_summary
from scribeprint.operators.trees import represent as tree_of_code
from scribeprint.session import shared_dir, stored
from scribeprint.sources.readers import spread

# Sizes and cap of the standard run.
TEST_SIZE, VAL_SIZE, CAP = 0.1, 0.1, 5000
# The run that tests on datasets it did not train on.
UNSEEN: Mapping[str, Mapping[str, float]] = {
    "gptsniffer": {"test_size": 1},
    "humaneval": {"val_size": 0.2},
    "mbpp": {"val_size": 0.2},
    "hmcorp": {"val_size": 0.2, "max_sample_count": 5000},
    "codenet": {"test_size": 1, "max_sample_count": 1480},
}
TEXT, TREE, BLEND = "text", "tree", "blend"


@dataclass(frozen=True)
class RunConfig:
    """What one run loads and how it splits it: both sizes, or ``config`` per dataset."""

    label: str
    test_size: float | None = None
    val_size: float | None = None
    max_sample_count: int | None = None
    name: str | None = None
    language: str | None = None
    config: Mapping[str, Mapping[str, float]] | None = None


def standard_configs(unseen: Mapping[str, Mapping[str, float]] = UNSEEN) -> list[RunConfig]:
    """All data, one language at a time, and a run that tests on datasets it did not train on.

    ``unseen`` gives sizes per dataset name: ``test_size`` 1 for the held-out ones.
    """
    sizes = {"test_size": TEST_SIZE, "val_size": VAL_SIZE, "max_sample_count": CAP}
    configs = [RunConfig("all", **sizes), RunConfig("java", language="java", **sizes),
               RunConfig("python", language="python", **sizes)]
    return [*configs, RunConfig("unseen", config=unseen)]


@dataclass(frozen=True)
class ModelOptions:
    """Which models take part and how. A blend needs both members."""

    models: tuple[str, ...] = (TEXT, TREE, BLEND)
    use_scaler: bool = False
    add_structural_features: bool = False
    text_uses_tree: bool = False
    max_iterations: int = learning.MAX_ITERATIONS
    tolerance: float = 1e-4
    weights: Mapping[str, float] | None = None

    def blend_weights(self) -> Mapping[str, float]:
        return self.weights or {TEXT: learning.TEXT_WEIGHT, TREE: learning.TREE_WEIGHT}


#: What the only variant of a run is called when options come without a name.
PLAIN = "plain"


@dataclass(frozen=True)
class RunTables:
    """What runs report, each as one table over all runs and variants.

    ``metrics``: counts, rates and seconds per config, variant, model and split. ``class_reports``: precision, recall,
    F1 and support per class of the same. ``splits``: rows per dataset entry and split. ``truncated``: texts per split
    that fill a model input of ``MAX_LENGTH`` tokens. ``iterations``: how often each fitted model went over its rows.
    """

    metrics: DataFrame
    class_reports: DataFrame
    splits: DataFrame
    truncated: DataFrame
    iterations: DataFrame


def run_report(samples: DataFrame, configs: Sequence[RunConfig],
               options: ModelOptions | Mapping[str, ModelOptions] = ModelOptions(),
               represent: Callable[[DataFrame], DataFrame] | None = None, tasks: int | None = None) -> DataFrame:
    """The ``metrics`` of ``run_tables``."""
    return run_tables(samples, configs, options, represent, tasks=tasks).metrics


def run_tables(samples: DataFrame, configs: Sequence[RunConfig],
               options: ModelOptions | Mapping[str, ModelOptions] = ModelOptions(),
               represent: Callable[[DataFrame], DataFrame] | None = None,
               results: str | None = None, tasks: int | None = None) -> RunTables:
    """Split, represent, train, predict and report for every config and every variant of ``options``.

    Samples are stored first and only read from there, so ids made by a scan hold. All splits are made next, and
    a sample gets them as one map. Then one pass over the texts makes what models need: hashed terms of the
    text, hashed tokens of its tree, structural features. These short rows are stored, and all models of all runs
    are fitted on filters of that one table. Seconds hold the shared steps and the run's own.

    Samples, rows and predictions stay in the shared folder (``runs-...``) until the user removes them. With
    ``results``, a folder of the user's, predictions and iterations are kept there by config and variant: a run
    that is repeated, say after a failure, replaces its own and leaves those of others, and the
    tables of metrics are over all that the folder holds. ``tasks`` deals few but heavy texts to so many tasks.
    """
    variants = options if isinstance(options, Mapping) else {PLAIN: options}
    for own in variants.values():
        learning.check_weights(own.blend_weights())
    begin = time.monotonic()
    spark = samples.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    results = (results or folder).rstrip("/")
    samples.write.parquet(f"{folder}/given")
    given = spark.read.schema(samples.schema).parquet(f"{folder}/given")
    assigned = assign_splits(given, configs)
    assigned.write.partitionBy("config").parquet(f"{folder}/splits")
    assigned = spark.read.schema(_SPLITS).parquet(f"{folder}/splits")
    tree_terms = any(o.text_uses_tree for o in variants.values())
    rows = model_rows(given, assigned, represent or _tree_with_tokens, tree_terms, tasks)
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    shared = time.monotonic() - begin

    for config in configs:
        split = F.element_at("splits", config.label)
        own_rows = rows.filter(split.isNotNull()).withColumn("split", split).drop("splits")
        for variant, own in variants.items():
            start = time.monotonic()
            predictions, counts = _train_and_predict(own_rows, own)
            _put(predictions, config.label, variant, f"{results}/predictions")
            seconds = shared + time.monotonic() - start
            done = [(model, n, own.max_iterations, seconds) for model, n in counts.items()]
            _put(spark.createDataFrame(done, "model string, iterations int, max_iterations int, seconds double")
                 .coalesce(1), config.label, variant, f"{results}/fits")
    return RunTables(*stored_reports(spark, results), split_summary(
        given.select("sample_id", "dataset", "language", "ai").join(assigned, "sample_id"), ["config"]),
        truncated_counts(rows), _read(spark, f"{results}/fits", _FITS).drop("seconds"))


_SPLITS = "sample_id string, split string, config string"
_KEYS = "config string, variant string"
_FITS = f"model string, iterations int, max_iterations int, seconds double, {_KEYS}"
_PREDICTIONS = f"model string, split string, sample_id string, y_true int, y_pred int, {_KEYS}"


def _put(df: DataFrame, config: str, variant: str, path: str) -> None:
    """Store the rows of one run; those of the same run that are there are replaced, others stay."""
    (df.withColumns({"config": F.lit(config), "variant": F.lit(variant)}).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("config", "variant").parquet(path))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stored_reports(spark: SparkSession, results: str) -> tuple[DataFrame, DataFrame]:
    """``metrics`` and ``class_reports`` of all runs in a folder of results."""
    predictions = _read(spark, f"{results}/predictions", _PREDICTIONS)
    by = ["config", "variant", "model", "split"]
    seconds = _read(spark, f"{results}/fits", _FITS).groupBy("config", "variant").agg(F.max("seconds").alias("seconds"))
    metrics = evaluation.binary_metrics(predictions, by).join(seconds, ["config", "variant"])
    return metrics, evaluation.class_report(predictions, by)


def assign_splits(samples: DataFrame, configs: Sequence[RunConfig]) -> DataFrame:
    """``config, sample_id, split`` of every run, for the samples that it uses."""
    keys = samples.select("sample_id", "dataset", "language", "ai", "label")
    parts = [split_datasets(keys, c.test_size, c.val_size, c.max_sample_count, c.name, c.language,
                            c.config).select(F.lit(c.label).alias("config"), "sample_id", "split")
             for c in configs]
    return reduce(DataFrame.unionByName, parts)


def truncated_counts(rows: DataFrame) -> DataFrame:
    """``config, split, n, truncated`` of a table of ``model_rows``."""
    opened = rows.select(F.explode("splits").alias("config", "split"), "full")
    return opened.groupBy("config", "split").agg(F.count("*").alias("n"), F.count_if("full").alias("truncated"))


def _tree_with_tokens(samples: DataFrame) -> DataFrame:
    return tree_of_code(samples, include_tokens=True)


def model_rows(samples: DataFrame, assigned: DataFrame, represent: Callable[[DataFrame], DataFrame] = _tree_with_tokens,
               tree_terms: bool = False, tasks: int | None = None) -> DataFrame:
    """One short row for each sample that some run uses; no text is in it.

    ``sample_id, label, splits`` (config to split), ``full`` (does the text fill a model input), ``code_terms``,
    ``tree_counts``, with ``tree_terms`` those of the tree's text, and the structural features. The splits are joined to
    the texts once; what is made of texts and of trees is joined as hashed counts.
    """
    listed = F.map_from_entries(F.collect_list(F.struct("config", "split")))  # one entry a config
    splits = assigned.groupBy("sample_id").agg(listed.alias("splits"))
    used = stored(spread(samples.join(splits, "sample_id"), tasks), "used-samples")
    full = encoding.mask_length(F.coalesce(F.col("code"), F.lit(""))) == encoding.MAX_LENGTH
    texts = learning.hash_terms(used.withColumn("full", full), ["sample_id", "label", "splits", "full"])
    trees = with_structural_features(represent(used), "tree")
    kept = ["sample_id", *FEATURES]
    if tree_terms:
        trees = learning.hash_terms(trees, [*kept, "tree"], "tree").withColumnRenamed("counts", "tree_terms")
        kept.append("tree_terms")
    trees = vectors.hash_tokens(trees, kept, "tree").withColumnRenamed("counts", "tree_counts")
    return texts.withColumnRenamed("counts", "code_terms").join(trees, "sample_id")


def train_and_predict(rows: DataFrame, options: ModelOptions = ModelOptions()) -> DataFrame:
    """Fit the models on the train rows; ``model, split, sample_id, y_true, y_pred`` of the rest.

    ``rows`` are those of ``model_rows``, with ``split`` in place of ``splits``.
    """
    return _train_and_predict(rows, options)[0]


def _train_and_predict(rows: DataFrame, options: ModelOptions) -> tuple[DataFrame, dict[str, int]]:
    """Predictions, and the iterations of each fitted model."""
    scores, iterations = {}, {}
    for name, fit in ((TEXT, _text_scores), (TREE, _tree_scores)):
        if name in options.models or BLEND in options.models:
            scores[name], iterations[name] = fit(rows, options)
    columns = ["model", "split", "sample_id", "y_true", "y_pred"]
    named = {name: scored.withColumn("model", F.lit(name)) for name, scored in scores.items()}
    parts = [named[name].select(*columns) for name in named if name in options.models]
    if BLEND in options.models:
        truth = rows.filter(F.col("split") != "train").select(
            "sample_id", "split", F.col("label").alias("y_true"))
        blended = learning.blend_scores(reduce(DataFrame.unionByName, named.values()), options.blend_weights())
        parts.append(blended.join(truth, "sample_id").withColumn("model", F.lit(BLEND)).select(*columns))
    return reduce(DataFrame.unionByName, parts), iterations


KEPT = ["sample_id", "split", "label"]


def _scored(model, held_out: DataFrame) -> DataFrame:
    return learning.predict(model, held_out, KEPT).withColumnRenamed("label", "y_true")


def _text_scores(rows: DataFrame, options: ModelOptions) -> tuple[DataFrame, int]:
    counts = "tree_terms" if options.text_uses_tree else "code_terms"
    terms = rows.select(*KEPT, counts)
    model = learning.fit_terms_classifier(terms.filter(F.col("split") == "train"), tol=options.tolerance, counts=counts,
                                          max_iterations=options.max_iterations)
    return _scored(model, terms.filter(F.col("split") != "train")), model.stages[-1].summary.totalIterations


def _tree_scores(rows: DataFrame, options: ModelOptions) -> tuple[DataFrame, int]:
    is_train = F.col("split") == "train"
    embedder = vectors.text_embedder("tree_counts").fit(rows.filter(is_train).select("tree_counts"))
    extra = list(FEATURES) if options.add_structural_features else []
    embedded = vectors.embed_text(rows.select(*KEPT, "tree_counts", *extra), embedder, [*KEPT, *extra])
    if extra:
        numbers = [F.col(c).cast("double") for c in extra]
        embedded = embedded.withColumn("embedding", F.concat("embedding", F.array(*numbers)))
    vector = "embedding"
    if options.use_scaler:
        scaler = vectors.fit_scaler(embedded.filter(is_train), vector)
        embedded, vector = vectors.apply_scaler(embedded, scaler, vector, "scaled"), "scaled"
    ready = embedded.select(*KEPT, vectors.as_vector(F.col(vector)).alias("features"))
    model = learning.fit_classifier(ready.filter(is_train), tol=options.tolerance,
                                    max_iterations=options.max_iterations)
    return _scored(model, ready.filter(~is_train)), model.summary.totalIterations

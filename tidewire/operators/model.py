"""Training, scoring and keeping tree ensembles, all through `pyspark.ml`."""

from __future__ import annotations

import datetime
import json
import logging
from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.scalar import confidence, is_finite, predict_label
from tidewire.operators import deep_forest
from tidewire.operators import metrics as M
from tidewire.operators.features import zero_features
from tidewire.operators.labels import class_weights
from tidewire.operators.split import random_split, time_split
from tidewire.schemas import BUNDLE_VERSION, FEATURE_NAMES
from tidewire.session import scratch_dir, spread, written_once

log = logging.getLogger(__name__)


@dataclass
class Trained:
    """A fitted classifier and where it came from."""

    model: Model
    metadata: dict = field(default_factory=dict)


def forest(seed: int = 42, trees: int = 300, depth: int = 30) -> RandomForestClassifier:
    """Random forest; Spark ends trees at depth 30 and splits on 256 bins."""
    return RandomForestClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=2, featureSubsetStrategy="sqrt", maxBins=256, maxMemoryInMB=256, seed=seed)


def boosted(seed: int = 42, rounds: int = 400, depth: int = 8) -> GBTClassifier:
    """Boosted trees, logistic loss; columns are sampled per node."""
    return GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.05,
        subsamplingRate=0.9, featureSubsetStrategy="0.9", maxBins=256, maxMemoryInMB=256, seed=seed)


def feature_array(table: DataFrame) -> Column:
    """The 34 values in order, from a `features` struct or from columns."""
    nested = "features" in table.columns
    return F.array(*[(F.col("features")[n] if nested else F.col(n)).cast("double") for n in FEATURE_NAMES])


def with_vector(table: DataFrame) -> DataFrame:
    """Adds `vector`. A row with a feature that is null, NaN or infinite ends the job that reads it: no pass of its own."""
    values = feature_array(table)
    checked = F.when(F.forall(values, is_finite), values).otherwise(
        F.raise_error(F.lit("a row holds non-finite features; clean the table first")).cast("array<double>"))
    return table.withColumn("vector", array_to_vector(checked))


def with_weight(table: DataFrame, estimator: Estimator) -> tuple[DataFrame, dict[int, int]]:
    """Row weights from the class counts (two rows): balanced, or benign / c2 on the c2 side when boosted."""
    rows = class_weights(table).collect()
    counts = {int(r["label"]): int(r["n_rows"]) for r in rows}
    if len(counts) < 2:
        raise ValueError(f"training data holds only one class: {sorted(counts)}")
    if isinstance(estimator, GBTClassifier):
        weights = {0: 1.0, 1: rows[0]["pos_weight"]}
    else:
        weights = {int(r["label"]): r["weight"] for r in rows}
    weight = F.when(F.col("label") == 1, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0])))
    return table.withColumn("weight", weight), counts


def keep_checkpoints(spark: SparkSession) -> None:
    """Boosting writes its errors down every ten rounds, where there is a folder for it; else each round's plan holds all before it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch_dir(spark, "boosting"))


def train(table: DataFrame, estimator: Estimator | None = None, dataset: str = "unknown") -> Trained:
    """Fits any `pyspark.ml` classifier (columns vector, label, weight) on a checked feature table."""
    estimator = estimator or forest()
    weighted, counts = with_weight(table, estimator)
    rows, n_rows = with_vector(weighted).select("vector", "label", "weight"), sum(counts.values())
    if isinstance(estimator, GBTClassifier):
        keep_checkpoints(table.sparkSession)
    model = deep_forest.fit(estimator, rows, n_rows) if deep_forest.fits(estimator, n_rows) else estimator.fit(rows)
    names = {0: "benign", 1: "c2"}
    return Trained(model, {
        "trained_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "dataset": dataset,
        "n_train": n_rows, "n_test": 0,
        "class_counts": {names[k]: v for k, v in sorted(counts.items())}, "metrics": {},
        "feature_names": list(FEATURE_NAMES), "bundle_version": BUNDLE_VERSION,
    })


def predict(trained: Trained, table: DataFrame, label: str = "predicted") -> DataFrame:
    """Every row with `proba_c2`, its label and confidence; the flow keeps its row, so nothing is joined."""
    scored = trained.model.transform(with_vector(table))
    p = F.get(vector_to_array(F.col("probability")), 1)
    return scored.select(*table.columns, p.alias("proba_c2")).withColumns({
        label: predict_label(F.col("proba_c2")), "confidence": confidence(F.col("proba_c2"))})


def evaluate(trained: Trained, test: DataFrame) -> DataFrame:
    """The nine metrics and four counts on held-out rows; also kept in the model's metadata."""
    scored = predict(trained, test).select("label", "proba_c2").persist()
    try:
        result = M.evaluate(scored)
        row = result.first().asDict()       # one row
    finally:
        scored.unpersist()
    trained.metadata["n_test"] = sum(row[c] for c in ("tn", "fp", "fn", "tp"))
    trained.metadata["metrics"] = {m: row[m] for m in M.METRICS}
    return test.sparkSession.createDataFrame([tuple(row.values())], result.schema)


def fit_and_evaluate(
    table: DataFrame, estimator: Estimator | None = None, split: str = "time", test_size: float = 0.25, seed: int = 42,
    zeroed: list[str] = [], dataset: str = "unknown", row_key: list[str] | None = None,
) -> tuple[Trained, DataFrame]:
    """Split, optionally blind some features on both sides, train, evaluate."""
    table, timed = needed(table, split, row_key)
    # what makes the table runs once: the split passes over it several times, training once per tree level, and both are
    # worth one move into even partitions
    table = spread(table).persist()
    sides = time_split(table, test_size, row_key) if timed else random_split(table, test_size, seed, row_key)
    if zeroed:
        sides = zero_features(sides, zeroed)
        dataset = f"{dataset} [zeroed: {','.join(zeroed)}]"
    sides = sides.select(*FEATURE_NAMES, "label", "is_test").persist()
    try:
        sides.count()
        table.unpersist()                       # the memory is for the binned rows, over which training passes once per level
        return fit_sides(sides, estimator, dataset)
    finally:
        sides.unpersist()
        table.unpersist()


def needed(table: DataFrame, split: str, row_key: list[str] | None) -> tuple[DataFrame, bool]:
    """The columns that splitting and training read, where a row key is given; and whether the split goes by time."""
    timed = split == "time" and "start_time" in table.columns
    if row_key:
        table = table.select(*dict.fromkeys([*FEATURE_NAMES, "label", *(["start_time"] if timed else []), *row_key]))
    return table, timed


def fit_sides(sides: DataFrame, estimator: Estimator | None, dataset: str) -> tuple[Trained, DataFrame]:
    """Trains on one side and evaluates on the other (`is_test`)."""
    trained = train(sides.filter(~F.col("is_test")), estimator, dataset)
    result = evaluate(trained, sides.filter("is_test"))
    row = result.first()
    if not row["tn"] + row["fp"] or not row["tp"] + row["fn"]:
        log.warning("the test side holds one class only: metrics of the other say nothing")
    return trained, result


def ablation(
    table: DataFrame, runs: dict[str, list[str]], make=forest, split: str = "time", test_size: float = 0.25, seed: int = 42,
    dataset: str = "unknown", row_key: list[str] | None = None,
) -> DataFrame:
    """One row of metrics per run: the features it blinds.

    All runs share one split of one written table, which goes when they are done: columns in files take a fraction of what
    cached rows do, and the runs leave nothing behind.
    """
    table, timed = needed(table, split, row_key)
    with written_once(spread(table), "ablation") as table:
        sides = time_split(table, test_size, row_key) if timed else random_split(table, test_size, seed, row_key)
        out = None
        for name, zeroed in runs.items():
            blind, source = (zero_features(sides, zeroed), f"{dataset} [zeroed: {','.join(zeroed)}]") if zeroed else (sides, dataset)
            _, result = fit_sides(blind.select(*FEATURE_NAMES, "label", "is_test"), make(), source)
            row = result.select(F.lit(name).alias("run"), F.lit(",".join(zeroed)).alias("zeroed"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def feature_importance(trained: Trained, spark: SparkSession, k: int = 10) -> DataFrame:
    values = trained.model.featureImportances.toArray().tolist()        # 34 numbers
    rows = list(zip(FEATURE_NAMES, values))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(k)


def metadata_table(trained: Trained, spark: SparkSession) -> DataFrame:
    m = trained.metadata
    schema = ("trained_at string, dataset string, n_train bigint, n_test bigint, class_counts map<string,bigint>, "
              "metrics map<string,double>, feature_names array<string>, bundle_version int")
    return spark.createDataFrame([tuple(m.get(c) for c in (
        "trained_at", "dataset", "n_train", "n_test", "class_counts", "metrics", "feature_names", "bundle_version"))], schema)


def save(trained: Trained, spark: SparkSession, path: str) -> None:
    PipelineModel(stages=[trained.model]).write().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(trained.metadata),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Trained:
    """Refuses newer bundles, warns when the features differ, accepts metadata with missing entries."""
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    version = metadata.get("bundle_version", 0)
    if version > BUNDLE_VERSION:
        raise ValueError(f"saved by a later release (bundle {version}; this one reads up to {BUNDLE_VERSION})")
    names = metadata.get("feature_names")
    if names and names != FEATURE_NAMES:
        log.warning("the model was trained on %d other features; predictions may be wrong", len(names))
    return Trained(PipelineModel.load(f"{path}/model").stages[0], metadata)

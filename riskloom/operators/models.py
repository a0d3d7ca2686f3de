"""Supervised models on assembled features, with training-only class weights."""

from __future__ import annotations

import math

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from riskloom.errors import ValidationError
from riskloom.operators import trees
from riskloom.operators.features import FeatureState, assemble
from riskloom.operators.forests import StoredForest
from riskloom.operators.quality import require_target

# The baseline settings of each model.
DECISION_THRESHOLD = 0.5
SEED = 42
LOGISTIC = {"maxIter": 2000, "tol": 1e-8, "elasticNetParam": 0.0, "standardization": False}
FOREST = {"trees": 200, "depth": 20, "least": 2, "share": 0.8, "bins": 256}
BOOSTING = {"rounds": 300, "depth": 4, "rate": 0.05, "share": 0.8, "columns": 0.8, "most": 1.0, "penalty": 1.0, "least": 1.0, "bins": 256}


@dataclass(frozen=True)
class Training:
    """Assembled training rows with their class counts."""

    rows: DataFrame
    counts: dict[int, int]
    names: tuple[str, ...] = ()

    @property
    def total(self) -> int:
        return self.counts[0] + self.counts[1]


def training_rows(prepared: DataFrame, state: FeatureState, target: str) -> Training:
    """The training partition only: holdout rows and labels never reach a fit."""
    train = prepared.where(F.col("split") == "train")
    counts = require_target(train, target)
    return Training(assemble(train.withColumn("label", F.col(target).cast("double")), state, ["label"]), counts, tuple(state.names))


def _balanced(training: Training) -> DataFrame:
    """Weights in the inverse ratio of the classes, as whole numbers: their sums do not depend on the order of addition."""
    common = math.gcd(*training.counts.values())
    each = {k: float(n // common) for k, n in training.counts.items()}
    weighted = training.rows.withColumn("weight", F.when(F.col("label") == 1, each[0]).otherwise(each[1]))
    return weighted.withColumn("order", F.xxhash64(vector_to_array("features"), "label")).sortWithinPartitions("order").drop("order")


def fit_logistic(training: Training, c: float = 1.0, **settings):
    """Class-balanced L2 logistic regression; the penalty is divided by the rows, as Spark averages the loss."""
    options = LOGISTIC | settings
    model = LogisticRegression(weightCol="weight", regParam=1.0 / (c * training.total), **options).fit(_balanced(training))
    if model.summary.totalIterations >= options["maxIter"]:
        raise ValidationError("Logistic regression did not converge within the iteration limit")
    # The summary holds the session, which cannot be sent to tasks once it has observed a metric (as `read_csv` does).
    model._java_obj.setSummary(training.rows.sparkSession._jvm.scala.Option.empty())
    return model


def _labelled(training: Training) -> DataFrame:
    return training.rows.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"))


def fit_forest(training: Training, seed: int = SEED, rows_per_class: int | None = None, **settings) -> trees.TreeEnsemble | StoredForest:
    """Random forest whose classes are balanced within each tree's bootstrap, on all labelled rows."""
    return trees.fit_forest(_labelled(training), training.counts, training.names, seed=seed, rows_per_class=rows_per_class, **(FOREST | settings))


def fit_boosting(training: Training, seed: int = SEED, rows_per_class: int | None = None, **settings) -> trees.TreeEnsemble:
    """Second-order boosted trees on all labelled rows; positives weigh negatives / positives of the training part."""
    return trees.fit_boosting(_labelled(training), training.counts, training.names, seed=seed, rows_per_class=rows_per_class, **(BOOSTING | settings))


FITTERS: dict[str, Callable] = {
    "logistic_regression": fit_logistic, "random_forest": fit_forest, "gradient_boosting": fit_boosting,
}


def positive_probability(model, df: DataFrame) -> DataFrame:
    """Adds `raw_score`, the probability of class 1, to rows with a `features` vector."""
    if isinstance(model, StoredForest):
        if not df.isStreaming:
            x = vector_to_array("features")
            return model.score(df, [x[j] for j in range(model.numFeatures)], "raw_score")
        # A stream has no distinct cells yet: each process must hold the forest.
        model = trees.ensemble_from_nodes(model.node_frame(df).toPandas(), model.names, model.kind)
    if isinstance(model, trees.TreeEnsemble):
        x = vector_to_array("features")
        return df.withColumn("raw_score", model.probability([x[j] for j in range(model.numFeatures)]))
    out = model.transform(df).withColumn("raw_score", vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction")

"""0-100 risk scores, anomaly percentiles, alerts and the fitted scorer that produces them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, ClassVar

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.errors import ValidationError
from riskloom.functions.columns import as_percent, check_bands, risk_level
from riskloom.operators.features import FeatureState, assemble, feature_columns
from riskloom.operators.iforest import ALERT_ABOVE, IsolationForest
from riskloom.operators.models import DECISION_THRESHOLD, positive_probability
from riskloom.operators.optimum import LogisticModel
from riskloom.operators.percentiles import PercentileIndex, build_index
from riskloom.operators.ranks import running_totals
from riskloom.operators.trees import TreeEnsemble

# The wording attached to scores and alerts.
PROBABILITY_BASIS = "uncalibrated model probability × 100"
ANOMALY_BASIS = "percentile of training-reference anomaly scores"
ANOMALY_DECISION = "Isolation Forest native predict == -1"


@dataclass(frozen=True)
class BandPolicy:
    low_upper: float = 30.0
    medium_upper: float = 70.0

    def __post_init__(self):
        check_bands(self.low_upper, self.medium_upper)


@dataclass(frozen=True)
class Scorer:
    """A fitted model with the feature state it was built for and the bands of its 0-100 scale.

    A kind of scorer states its contract as named conditions; constructing one that breaks some raises with their names.
    """

    model_name: str
    model: Any
    state: FeatureState
    policy: BandPolicy = field(default_factory=BandPolicy, kw_only=True)
    score_kind: ClassVar[str]
    basis: ClassVar[str]
    threshold: ClassVar[float | None] = None
    reference_rows: ClassVar[int] = 0

    def __post_init__(self):
        broken = [name for name, holds in self.contract().items() if not holds]
        if broken:
            raise ValidationError(f"{type(self).__name__} refused: {', '.join(broken)}")

    def contract(self) -> dict[str, bool]:
        names = self.state.names
        return {"a name": isinstance(self.model_name, str) and bool(self.model_name.strip()), "features": bool(names), "distinct features": len(set(names)) == len(names)}

    def raw(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Kept columns plus `raw_score`; the model runs once per row."""
        raise NotImplementedError

    def raw_of(self, features: Sequence[Column]) -> Column | None:
        """`raw_score` from feature columns, where the model is a column expression."""
        return None

    def scaled(self, scored: DataFrame) -> DataFrame:
        """Adds `score`, 0 to 100, to rows with `raw_score`."""
        raise NotImplementedError

    def alert(self) -> Column:
        raise NotImplementedError

    def evaluator(self) -> Callable[[np.ndarray], np.ndarray] | None:
        """The 0-100 score as a function of rows of prepared features, where it needs nothing but the model."""
        return None


@dataclass(frozen=True)
class ProbabilityScorer(Scorer):
    """Class-1 probability of a two-class model, times 100; alerts from a threshold on."""

    threshold: float = field(default=DECISION_THRESHOLD, kw_only=True)
    score_kind = "probability"
    basis = PROBABILITY_BASIS

    def contract(self) -> dict[str, bool]:
        share = isinstance(self.threshold, (int, float)) and 0 <= self.threshold <= 1
        return super().contract() | {
            "a model of two classes": getattr(self.model, "numClasses", None) == 2,
            "a model of these features": getattr(self.model, "numFeatures", len(self.state.names)) == len(self.state.names), "a threshold from 0 to 1": share}

    @property
    def decision_method(self) -> str:
        return f"positive-class probability >= {self.threshold:g}"

    def raw_of(self, features: Sequence[Column]) -> Column | None:
        return self.model.probability(features) if isinstance(self.model, (TreeEnsemble, LogisticModel)) else None

    def raw(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        direct = self.raw_of(feature_columns(self.state))
        if direct is not None:
            return df.select(*keep, direct.alias("raw_score"))
        return positive_probability(self.model, assemble(df, self.state, keep)).drop("features")

    def scaled(self, scored: DataFrame) -> DataFrame:
        return scored.withColumn("score", as_percent("raw_score"))

    def alert(self) -> Column:
        return F.col("raw_score") >= F.lit(self.threshold)

    def evaluator(self) -> Callable[[np.ndarray], np.ndarray] | None:
        if isinstance(self.model, TreeEnsemble):
            shared = self.model._shared
            return lambda x: shared.value.predict(x) * 100.0
        if isinstance(self.model, LogisticModel):
            model = self.model
            return lambda x: model.predict(x) * 100.0
        if isinstance(self.model, LogisticRegressionModel):
            weights, intercept = self.model.coefficients.toArray(), float(self.model.intercept)
            return lambda x: 100.0 / (1.0 + np.exp(-(x @ weights + intercept)))
        return None


@dataclass(frozen=True)
class AnomalyScorer(Scorer):
    """Percentile of an isolation forest's score among those of its training rows; alerts at the forest's own cut-off."""

    reference: PercentileIndex
    score_kind = "anomaly"
    basis = ANOMALY_BASIS
    decision_method = ANOMALY_DECISION

    def contract(self) -> dict[str, bool]:
        return super().contract() | {
            "a forest of these features": isinstance(self.model, IsolationForest) and list(self.model.names) == self.state.names,
            "reference scores": self.reference.rows > 0, "finite reference scores": not self.reference.unusable}

    @property
    def reference_rows(self) -> int:
        return self.reference.rows

    def raw_of(self, features: Sequence[Column]) -> Column | None:
        return self.model.score(features)

    def raw(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return df.select(*keep, self.raw_of(feature_columns(self.state)).alias("raw_score"))

    def scaled(self, scored: DataFrame) -> DataFrame:
        return self.reference.percentiles(scored, "raw_score", out="score")

    def alert(self) -> Column:
        return F.col("raw_score") > ALERT_ABOVE


def anomaly_percentile(new: DataFrame, reference: DataFrame, score: str, *, out: str = "percentile") -> DataFrame:
    """Percent of reference scores not above each row's score, for references of any size.

    Reference and new scores are ranked together once per distinct value, and the count is joined
    back on the score; that side has one row per score, so adaptive execution can split a hot score.
    A null or NaN score has no percentile (null); such reference scores do not count.
    """
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    both = reference.select(value.alias("s"), F.lit(1).alias("is_ref")).unionByName(
        new.select(value.alias("s"), F.lit(0).alias("is_ref"))).where(F.col("s").isNotNull())
    totals = running_totals(both, "s", {"refs": F.sum("is_ref")})
    size = reference.where(value.isNotNull()).count()
    shares = totals.select(F.col("s").alias("__s"), (F.col("cum_refs") / F.lit(size) * 100.0).alias(out))
    return new.withColumn("__s", value).join(shares, "__s", "left").drop("__s")


def training_reference(model: IsolationForest, train: DataFrame, state: FeatureState) -> PercentileIndex:
    """Index of the raw anomaly scores of the training rows, the reference of the percentile scale, built once."""
    return build_index(train.select(model.score(feature_columns(state)).alias("raw_score")), "raw_score")


def score_batch(df: DataFrame, scorer: Scorer, keep: Sequence[str]) -> DataFrame:
    """Scores, bands and alerts for raw rows in one plan; the model runs once per row."""
    scored = scorer.scaled(scorer.raw(df, keep))
    return scored.select(
        *keep, F.lit(scorer.model_name.strip()).alias("model_name"), F.col("raw_score"), F.col("score"),
        risk_level("score", scorer.policy.low_upper, scorer.policy.medium_upper).alias("risk_level"),
        F.lit(scorer.score_kind).alias("score_kind"), F.lit(scorer.basis).alias("score_basis"),
        scorer.alert().alias("model_alert"), F.lit(scorer.decision_method).alias("decision_method"),
    )

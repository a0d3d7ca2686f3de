"""Optimality of a penalised logistic fit: objective, gradient and curvature by one aggregate, and Newton steps to the optimum."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.errors import ValidationError
from riskloom.operators.models import Training

#: Largest gradient component at which a fit counts as optimal.
TOLERANCE = 1e-10
STEPS = 25


@dataclass(frozen=True)
class LogisticModel:
    """Weights and intercept of a two-class logistic model, scored as a column expression."""

    weights: tuple[float, ...]
    intercept: float
    numClasses = 2

    @property
    def numFeatures(self) -> int:
        return len(self.weights)

    def probability(self, features: Sequence[Column]) -> Column:
        margin = F.lit(self.intercept)
        for weight, x in zip(self.weights, features, strict=True):
            margin = margin + F.lit(weight) * x
        return 1.0 / (1.0 + F.exp(-margin))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(x @ np.array(self.weights) + self.intercept)))

    def weight_frame(self, spark: SparkSession) -> DataFrame:
        """One row per weight by feature position, the intercept at -1."""
        return spark.createDataFrame([(-1, self.intercept), *enumerate(self.weights)], "position int, weight double")


def model_from_weights(rows: Sequence) -> LogisticModel:
    """The model of `weight_frame` rows."""
    found = {r.position: r.weight for r in rows}
    if sorted(found) != list(range(-1, len(found) - 1)):
        raise ValidationError("Stored weights need one intercept and one weight for every feature")
    return LogisticModel(tuple(found[i] for i in range(len(found) - 1)), found[-1])


@dataclass(frozen=True)
class Certificate:
    """Where a fit stands: the penalised objective, its gradient (weights, then intercept) and its curvature."""

    objective: float
    gradient: np.ndarray
    hessian: np.ndarray | None

    @property
    def optimal(self) -> bool:
        return bool(np.abs(self.gradient).max() <= TOLERANCE)


def certificate(training: Training, weights: Sequence[float], intercept: float, *, c: float = 1.0, curvature: bool = False) -> Certificate:
    """The class-balanced, L2-penalised log loss of given coefficients over all training rows, and its derivatives.

    Each class weighs one half; the penalty is that of `fit_logistic`. A task sums its rows in numpy, and what leaves it is
    one number per feature (per pair of features with `curvature`), added up per position; the driver gets those sums only.
    """
    point = np.append(np.asarray(weights, np.float64), float(intercept))
    size = len(point)
    share = {k: 0.5 / n for k, n in training.counts.items()}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, slope, bend = 0.0, np.zeros(size), np.zeros((size, size)) if curvature else np.zeros((0, 0))
        for batch in batches:
            if not len(batch):
                continue
            x = np.column_stack([np.stack(batch["x"].to_numpy()).reshape(len(batch), size - 1), np.ones(len(batch))])
            y = batch["label"].to_numpy()
            w, margin = np.where(y == 1, share[1], share[0]), x @ point
            p = 1.0 / (1.0 + np.exp(-margin))
            loss += float((w * np.logaddexp(0.0, np.where(y == 1, -margin, margin))).sum())
            slope += x.T @ (w * (p - y))
            if curvature:
                bend += x.T @ (x * (w * p * (1.0 - p))[:, None])
        values = np.concatenate([[loss], slope, bend.ravel()])
        yield pd.DataFrame({"position": np.arange(len(values)), "value": values})

    rows = training.rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    added = rows.mapInPandas(sums, "position long, value double").groupBy("position").agg(F.sum("value").alias("value"))
    values = np.zeros(1 + size + (size * size if curvature else 0))
    for r in added.collect():  # one row per feature, or per pair of features
        values[r.position] = r.value
    penalty = np.append(np.full(size - 1, 1.0 / (c * training.total)), 0.0)
    hessian = values[1 + size:].reshape(size, size) + np.diag(penalty) if curvature else None
    return Certificate(float(values[0] + 0.5 * (penalty * point * point).sum()), values[1:1 + size] + penalty * point, hessian)


def polish(training: Training, weights: Sequence[float], intercept: float, *, c: float = 1.0, steps: int = STEPS) -> tuple[LogisticModel, Certificate]:
    """Newton steps from a fit to the optimum of its objective, halved where one would raise it.

    The curvature is one number per pair of features on the driver, so this suits models of up to some thousand features;
    `certificate` alone has no such bound. Raises where the optimum is not reached.
    """
    point = np.append(np.asarray(weights, np.float64), float(intercept))
    here = certificate(training, point[:-1], point[-1], c=c, curvature=True)
    for _ in range(steps):
        if here.optimal:
            return LogisticModel(tuple(map(float, point[:-1])), float(point[-1])), here
        step = np.linalg.solve(here.hessian, here.gradient)
        while True:
            there = certificate(training, (point - step)[:-1], (point - step)[-1], c=c, curvature=True)
            if there.objective <= here.objective + 1e-12 * max(1.0, abs(here.objective)):
                break
            step = step / 2
            if np.abs(step).max() < 1e-15:
                raise ValidationError("Logistic regression found no lower objective")
        point, here = point - step, there
    raise ValidationError(f"Logistic regression did not reach its optimum in {steps} Newton steps")

"""Train-only imputation, scaling and one-hot encoding, kept as a small fitted state."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.errors import ValidationError
from riskloom.functions.columns import calendar_parts, is_infinite
from riskloom.operators.quality import require_columns, require_numeric
from riskloom.operators.ranks import exact_quantiles
from riskloom.operators.split import SPLITS, chronological_split, require_ordered, stratified_split
from riskloom.schema import RELATED_CATEGORICAL, RELATED_NUMERIC, RELATED_TARGET, WIDE_FEATURES, WIDE_TARGET

MAX_CATEGORIES = 10_000


@dataclass(frozen=True)
class NumericState:
    """Training median, mean and population deviation (1 when constant) of one column."""

    name: str
    median: float | None
    mean: float
    scale: float


@dataclass(frozen=True)
class CategoryState:
    name: str
    fill: str
    categories: tuple[str, ...]


@dataclass(frozen=True)
class FeatureState:
    """Everything a transform needs; ordered output names follow the fitted order."""

    numeric: tuple[NumericState, ...]
    categorical: tuple[CategoryState, ...] = ()
    dropped: tuple[str, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [n.name for n in self.numeric] + [f"{c.name}_{v}" for c in self.categorical for v in c.categories]

    @property
    def inputs(self) -> list[str]:
        return [n.name for n in self.numeric] + [c.name for c in self.categorical]

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> FeatureState:
        raw = json.loads(text)
        return FeatureState(
            tuple(NumericState(**n) for n in raw["numeric"]),
            tuple(CategoryState(c["name"], c["fill"], tuple(c["categories"])) for c in raw["categorical"]),
            tuple(raw["dropped"]),
        )


def _number(name: str) -> Column:
    return F.nanvl(F.col(name).cast("double"), F.lit(None))


def fit_features(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> FeatureState:
    """Fits on the given rows only.

    Mean and deviation after imputation follow from the counts and moments of the present values
    and the median, so no second pass over imputed data is needed; medians are only searched for
    columns that have missing cells.
    """
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(numeric):
        x = _number(c)
        aggregates += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    row = train.agg(*aggregates).first()
    rows = row["rows"]
    if not rows:
        raise ValidationError("Training partition is empty")
    gaps = [c for i, c in enumerate(numeric) if 0 < row[f"n{i}"] < rows]
    medians = {}
    if gaps:
        medians = {r.column_name: r.median for r in exact_quantiles(train, gaps, {"median": 0.5}).collect()}
    states, dropped = [], []
    for i, c in enumerate(numeric):
        n = row[f"n{i}"]
        if n == 0:
            dropped.append(c)
            continue
        mean, variance, median = row[f"m{i}"], row[f"v{i}"], medians.get(c)
        if median is not None:
            filled = rows - n
            joined = mean + (median - mean) * filled / rows
            variance = (n * (variance + (mean - joined) ** 2) + filled * (median - joined) ** 2) / rows
            mean = joined
        scale = variance ** 0.5
        states.append(NumericState(c, median, mean, scale if scale > 1e-12 * max(1.0, abs(mean)) else 1.0))
    return FeatureState(tuple(states), tuple(_fit_category(train, c) for c in categorical), tuple(dropped))


def _fit_category(train: DataFrame, name: str) -> CategoryState:
    counts = (
        train.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = counts.orderBy(F.desc("n"), F.asc("value")).limit(MAX_CATEGORIES + 1).collect()
    if not found:
        raise ValidationError(f"{name} has no known value in training")
    if len(found) > MAX_CATEGORIES:
        raise ValidationError(f"{name} has more than {MAX_CATEGORIES} values: one column each is too wide, encode it with categories.fit_categories")
    return CategoryState(name, found[0].value, tuple(sorted(r.value for r in found)))


def feature_columns(state: FeatureState) -> list[Column]:
    """Standardised and one-hot columns in fitted order; an unseen category is all zeros."""
    out = []
    for n in state.numeric:
        x = _number(n.name)
        if n.median is not None:
            x = F.coalesce(x, F.lit(n.median))
        out.append(((x - F.lit(n.mean)) / F.lit(n.scale)).alias(n.name))
    for c in state.categorical:
        value = F.coalesce(F.col(c.name).cast("string"), F.lit(c.fill))
        out += [(value == F.lit(v)).cast("double").alias(f"{c.name}_{v}") for v in c.categories]
    return out


def transform_features(df: DataFrame, state: FeatureState, keep: Sequence[str] = ()) -> DataFrame:
    """Kept columns plus one column per feature."""
    require_columns(df, state.inputs, "features")
    return df.select(*keep, *feature_columns(state))


def assemble(df: DataFrame, state: FeatureState, keep: Sequence[str] = ()) -> DataFrame:
    """Kept columns plus one `features` vector built straight from the raw columns."""
    require_columns(df, state.inputs, "features")
    return df.select(*keep, array_to_vector(F.array(*feature_columns(state))).alias("features"))


def split_problems(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row for each expected part: rows, bad_cells (missing or not finite), and rows by label."""
    require_columns(df, [*features, target, "split"], "splits")
    bad = sum((F.coalesce(F.isnan(x) | is_infinite(x), F.lit(True)).cast("long") for x in (F.col(c).cast("double") for c in features)), F.lit(0).cast("long"))
    counted = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(bad).alias("bad_cells"), F.count_if(F.col(target) == 0).alias("zeros"), F.count_if(F.col(target) == 1).alias("ones"))
    parts = df.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return parts.join(counted, "split", "left").fillna(0)


def validate_splits(df: DataFrame, features: Sequence[str], target: str, *, training_target: bool = True) -> None:
    """Each part must have rows, finite features and both labels; training labels only count with `training_target`."""
    told = []
    for r in split_problems(df, features, target).collect():
        judged = training_target or r.split != "train"
        faults = {"no rows": not r.rows, f"{r.bad_cells} missing or infinite cells": r.bad_cells, "labels other than 0 and 1": judged and r.zeros + r.ones < r.rows,
                  "one class only": judged and r.rows and not (r.zeros and r.ones)}
        told += [f"{r.split}: {fault}" for fault, holds in faults.items() if holds]
    if told:
        raise ValidationError("; ".join(sorted(told)))


def prepare_wide(df: DataFrame, order: str | None = None) -> tuple[DataFrame, FeatureState]:
    """Chronological split of the wide table and the state fitted on its training part.

    Rows carry no order of their own: name an `order` column to have the source order checked.
    """
    require_columns(df, [*WIDE_FEATURES, WIDE_TARGET], "wide_transactions")
    numeric = require_numeric(df, list(WIDE_FEATURES))
    if order:
        require_ordered(numeric, order, "Time")
    split, _ = chronological_split(numeric, "Time", WIDE_TARGET)
    return split, fit_features(split.where(F.col("split") == "train"), WIDE_FEATURES)


def related_features(df: DataFrame) -> DataFrame:
    """Amounts as numbers plus calendar parts of the timestamp; raises on unreadable cells."""
    require_columns(df, [RELATED_TARGET, "Amount", "TransactionAmount", "Timestamp", "Category"], "transactions")
    out = require_numeric(df, ["Amount", "TransactionAmount"])
    time = F.try_to_timestamp(F.col("Timestamp").cast("string"))
    if out.where(time.isNull()).limit(1).count():
        raise ValidationError("Timestamp contains missing or unparseable values")
    parts = calendar_parts(time)
    return out.withColumns({
        "TimestampHour": parts["hour"], "TimestampDayOfWeek": parts["day_of_week"], "TimestampMonth": parts["month"],
    })


def prepare_related(df: DataFrame, key: str = "TransactionID", seed: int = 42) -> tuple[DataFrame, FeatureState]:
    """Seeded stratified split of the joined table and the state fitted on its training part."""
    out = stratified_split(related_features(df), key, RELATED_TARGET, seed)
    return out, fit_features(out.where(F.col("split") == "train"), RELATED_NUMERIC, RELATED_CATEGORICAL)


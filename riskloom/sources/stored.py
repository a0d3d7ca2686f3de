"""Readers of what the sinks wrote: metrics, curves and bounded backgrounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.errors import ValidationError
from riskloom.operators.explain import MAX_BACKGROUND_ROWS, background_rows
from riskloom.operators.quality import metric_range_problems, require_columns

# The columns of a stored evaluation and the partitions that may be asked for.
UNIT_METRICS = ("precision", "recall", "f1", "roc_auc", "pr_auc", "prevalence", "alert_rate")
COUNT_METRICS = ("true_negative", "false_positive", "false_negative", "true_positive")
REPORTED_SPLITS = ("validation", "test")


def read_performance(spark: SparkSession, path: str, partition: str = "test") -> DataFrame:
    """Stored metrics of one partition, range-checked; the partition filter prunes directories."""
    if partition not in REPORTED_SPLITS:
        raise ValidationError("Partition must be validation or test")
    try:
        df = spark.read.parquet(path).where(F.col("split") == partition)
    except AnalysisException as error:
        raise ValidationError("The model evaluation is unavailable") from error
    require_columns(df, ["model_name", "score_kind", "decision_rule", *UNIT_METRICS, *COUNT_METRICS], "evaluation")
    if not df.limit(1).count():
        raise ValidationError("The evaluation contains no model rows")
    if df.where(~F.coalesce(F.col("score_kind").isin("probability", "anomaly"), F.lit(False))).limit(1).count():
        raise ValidationError("The evaluation contains an unsupported score kind")
    if metric_range_problems(df, UNIT_METRICS, COUNT_METRICS).limit(1).count():
        raise ValidationError("The evaluation contains an out-of-range metric")
    return df


def read_background(spark: SparkSession, path: str, names: Sequence[str]) -> list[list[float]]:
    """1 to 100 finite background rows with exactly the fitted feature columns."""
    df = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    if df.columns != list(names):
        raise ValidationError("background columns and order must match the fitted model")
    if df.limit(MAX_BACKGROUND_ROWS + 1).count() > MAX_BACKGROUND_ROWS:
        raise ValidationError(f"The background must hold 1 to {MAX_BACKGROUND_ROWS} rows")
    return background_rows(df.select(*[F.col(n).try_cast("double").alias(n) for n in names]), names)

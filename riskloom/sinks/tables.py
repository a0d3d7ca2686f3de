"""Writers for profiles and evaluations, as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from riskloom.errors import ValidationError


def write_profiles(profiles: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Each profile as its own table below a folder; returns their paths."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in profiles}
    for name, df in profiles.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def write_evaluation(metrics: DataFrame, curves: DataFrame | None, folder: str, rules: Mapping[str, tuple[str, str]]) -> dict[str, str]:
    """Metrics partitioned by split, with score kind and decision rule per model, and the curve points.

    Metrics that already hold score kind and rule are written as they are; a model without rule is refused.
    Curves can have one point per distinct score, so they are written as produced, never gathered.
    """
    spark = metrics.sparkSession
    own = [c for c in ("score_kind", "decision_rule") if c in metrics.columns]
    named = {r[0] for r in metrics.select("model_name").distinct().collect()}  # one row per model
    if len(own) < 2 and (without := sorted(named - set(rules))):
        raise ValidationError(f"Models without score kind and decision rule: {without}")
    # One row per model, given by the caller.
    kinds = spark.createDataFrame([(m, k, r) for m, (k, r) in rules.items()], "model_name string, score_kind string, decision_rule string")
    paths = {"metrics": f"{folder.rstrip('/')}/metrics", "curves": f"{folder.rstrip('/')}/curves"}
    full = metrics if len(own) == 2 else metrics.drop(*own).join(F.broadcast(kinds), "model_name")
    full.write.mode("overwrite").partitionBy("split").parquet(paths["metrics"])
    if curves is not None:
        curves.write.mode("overwrite").partitionBy("split", "curve").parquet(paths["curves"])
    return paths


def append_baseline(metrics: DataFrame, path: str, config: Mapping[str, str], run: str) -> None:
    """Adds a run's metric rows with its settings to the shared baseline table.

    A run has a partition of its own, so repeating one, also after a lost driver, replaces its rows instead of doubling them.
    """
    if not run.strip() or "/" in run or "=" in run:
        raise ValidationError("A baseline run needs a name without / and =")
    settings = F.create_map(*[F.lit(str(x)) for pair in config.items() for x in pair]) if config else F.lit(None).cast("map<string,string>")
    metrics.withColumn("config", settings).write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")

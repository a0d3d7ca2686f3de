"""Comparison of fitted scorers on the validation and test parts, without fitting or tuning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskloom.errors import ValidationError
from riskloom.operators.metrics import decision_rule, evaluate_models, evaluation_curves, require_scores
from riskloom.operators.quality import stack
from riskloom.operators.scoring import Scorer, score_batch
from riskloom.session import cut_lineage

KEYS = ("model_name", "split")


def check_scorers(scorers: Sequence[Scorer]) -> None:
    """At least one scorer, unique non-empty names, and one shared feature order."""
    if not scorers:
        raise ValidationError("Nothing to compare: no scorer given")
    names = [s.model_name.strip() for s in scorers]
    if len(set(names)) != len(names):
        raise ValidationError("Compared models need unique names")
    if any(s.state.names != scorers[0].state.names for s in scorers):
        raise ValidationError("Compared models must share their feature names and order")


def held_out_scores(prepared: DataFrame, target: str, scorers: Sequence[Scorer]) -> DataFrame:
    """Long table of held-out scores (model_name, split, label, score, alert), each model run once.

    Probabilities and raw anomaly scores are ranked as they are; the scored rows are stored because
    every metric and curve reads them.
    """
    check_scorers(scorers)
    held = prepared.where(F.col("split").isin("validation", "test"))
    parts = [
        score_batch(held, s, ["split", target]).select(
            "model_name", "split", F.col(target).cast("int").alias("label"), F.col("raw_score").alias("score"),
            F.col("model_alert").cast("int").alias("alert"))
        for s in scorers
    ]
    return cut_lineage(stack(parts))


def compare_scorers(prepared: DataFrame, target: str, scorers: Sequence[Scorer]) -> tuple[DataFrame, DataFrame]:
    """(metrics, curves) per model and partition; metrics carry score kind and decision rule."""
    scored = held_out_scores(prepared, target, scorers)
    for kind in {s.score_kind for s in scorers}:
        named = [s.model_name for s in scorers if s.score_kind == kind]
        require_scores(scored.where(F.col("model_name").isin(*named)), "label", "score", "alert",
                       probability=kind == "probability", keys=KEYS)
    kinds = scored.sparkSession.createDataFrame(
        [(s.model_name, s.score_kind, decision_rule(s.score_kind, s.threshold)) for s in scorers],
        "model_name string, score_kind string, decision_rule string")
    # One row per compared model.
    report = evaluate_models(scored, keys=KEYS).join(F.broadcast(kinds), "model_name")
    return report, evaluation_curves(scored, keys=KEYS)

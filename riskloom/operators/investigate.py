"""Per-case investigation records: prediction, explanation and top contributors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskloom.errors import ValidationError
from riskloom.operators.explain import DEFAULT_EVALS, explain_cases, top_of_array
from riskloom.operators.features import transform_features
from riskloom.operators.payload import require_case_ids
from riskloom.operators.scoring import Scorer, score_batch

MAX_CONTRIBUTORS = 30
AGREEMENT_RELATIVE, AGREEMENT_ABSOLUTE = 1e-6, 1e-4


def investigate(df: DataFrame, case: str, scorer: Scorer, background: Sequence[Sequence[float]], *,
                time: str = "Time", amount: str = "Amount", top: int = 5, max_evals: int = DEFAULT_EVALS, seed: int = 42) -> DataFrame:
    """One record per case: id, time, amount, prediction, explanation, top_contributors, agrees.

    Case identifiers join each prediction with its explanation; repeated ones are refused.
    """
    if not 1 <= top <= MAX_CONTRIBUTORS:
        raise ValidationError(f"top_contributors must be from 1 to {MAX_CONTRIBUTORS}")
    cases = require_case_ids(df, case)
    predicted = score_batch(
        cases.withColumns({"__time": F.col(time).cast("double"), "__amount": F.col(amount).cast("double")}),
        scorer, ["case_id", "__time", "__amount"])
    explained = explain_cases(transform_features(cases, scorer.state, ["case_id"]), "case_id", scorer, background,
                              max_evals=max_evals, seed=seed)
    prediction = F.struct("model_name", "score", "score_kind", "score_basis", "risk_level", "model_alert", "decision_method")
    explanation = F.struct("model_name", "score_kind", "score_basis", "score", "baseline_score", "output_scale", "attributions",
                           "max_evals", "additive")
    left = predicted.select("case_id", F.col("__time").alias("time"), F.col("__amount").alias("amount"), prediction.alias("prediction"))
    right = explained.select("case_id", explanation.alias("explanation"))
    gap = F.abs(F.col("explanation.score") - F.col("prediction.score"))
    agrees = F.col("explanation.additive") & (gap <= AGREEMENT_ABSOLUTE + AGREEMENT_RELATIVE * F.abs("prediction.score"))
    return left.join(right, "case_id").select(
        F.col("case_id").alias("transaction_id"), "time", "amount", "prediction", "explanation",
        top_of_array("explanation.attributions", top).alias("top_contributors"), agrees.alias("agrees"))


def require_agreement(records: DataFrame) -> DataFrame:
    if records.where(~F.coalesce(F.col("agrees"), F.lit(False))).limit(1).count():
        raise ValidationError("Explanation does not match the transaction prediction")
    return records

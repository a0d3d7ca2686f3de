"""Exact confusion, ranking and curve metrics, grouped by any key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskloom.errors import ValidationError
from riskloom.functions.columns import is_infinite, ratio, zero_safe_ratio
from riskloom.operators.ranks import running_totals

_POSITIVE = "pos"
_NEGATIVE = "neg"


def _sums(label: str, score: str) -> dict:
    """Class counts per distinct score; rows without a score count for neither class."""
    known = F.col(score).isNotNull()
    return {
        _POSITIVE: F.sum(F.when(known & (F.col(label) == 1), 1).otherwise(0)),
        _NEGATIVE: F.sum(F.when(known & (F.col(label) == 0), 1).otherwise(0)),
    }


def confusion_metrics(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall, F1, prevalence and alert rate; zero where a rate is undefined."""
    y, p = F.col(label), F.col(prediction).cast("int")
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if((y == 0) & (p == 0)).alias("true_negative"), F.count_if((y == 0) & (p == 1)).alias("false_positive"),
        F.count_if((y == 1) & (p == 0)).alias("false_negative"), F.count_if((y == 1) & (p == 1)).alias("true_positive"),
    )
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return counts.select(
        "*",
        (tp + fp).alias("predicted_positive"),
        zero_safe_ratio(tp, tp + fp).alias("precision"),
        zero_safe_ratio(tp, tp + fn).alias("recall"),
        zero_safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + fn, F.col("row_count")).alias("prevalence"),
        ratio(tp + fp, F.col("row_count")).alias("alert_rate"),
    )


def ranking_metrics(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision, from one running total over distinct scores."""
    totals = running_totals(df.select(*keys, score, label), score, _sums(label, score), keys, descending=True)
    pos, neg = F.col(_POSITIVE), F.col(_NEGATIVE)
    cum_pos, cum_neg = F.col("cum_pos"), F.col("cum_neg")
    area = F.sum(neg * (cum_pos - pos / 2.0))
    steps = F.sum(pos * cum_pos / (cum_pos + cum_neg).cast("double"))
    return totals.groupBy(*keys).agg(
        ratio(area, F.sum(pos) * F.sum(neg)).alias("roc_auc"),
        ratio(steps, F.sum(pos)).alias("pr_auc"),
    )


def _class_totals(df: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(F.col(label) == 1).alias("all_pos"), F.count_if(F.col(label) == 0).alias("all_neg"))


def _with_totals(points: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return points.join(totals, list(keys), "left")
    row = totals.first()
    return points.withColumns({"all_pos": F.lit(row.all_pos), "all_neg": F.lit(row.all_neg)})


def roc_curve(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """ROC points by descending score: the origin, then every point that is not on a straight run."""
    sums = _sums(label, score) | {"one": F.first(F.lit(1))}
    points = running_totals(df.select(*keys, score, label), score, sums, keys, descending=True, following=True)
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    kept = points.where((F.col("cum_one") == 1) | F.col("next_one").isNull() | bend)
    totals = _class_totals(df, label, keys)
    curve = _with_totals(kept, totals, keys).select(
        *keys, F.col("cum_one").cast("long").alias("place"), F.col(score).alias("threshold"),
        ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"), ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )
    origin = totals.select(*keys, F.lit(0).cast("long").alias("place"), F.lit(float("inf")).alias("threshold"),
                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(curve)


def pr_curve(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision-recall points, one per distinct score in descending order, then the closing (1, 0).

    `place` counts from the highest score; the closing point has place 0, so ordering by place
    descending gives ascending thresholds with the closing point last.
    """
    sums = _sums(label, score) | {"one": F.first(F.lit(1))}
    points = running_totals(df.select(*keys, score, label), score, sums, keys, descending=True)
    totals = _class_totals(df, label, keys)
    curve = _with_totals(points, totals, keys).select(
        *keys, F.col("cum_one").cast("long").alias("place"), F.col(score).alias("threshold"),
        zero_safe_ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        F.coalesce(ratio(F.col("cum_pos"), F.col("all_pos")), F.lit(1.0)).alias("recall"),
    )
    closing = totals.select(*keys, F.lit(0).cast("long").alias("place"), F.lit(None).cast("double").alias("threshold"),
                            F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(closing)


def require_scores(df: DataFrame, label: str, score: str, prediction: str | None = None, *,
                   probability: bool, keys: Sequence[str] = ()) -> None:
    """Labels 0/1 with both classes per group, finite scores (in [0, 1] for probabilities), 0/1 predictions."""
    s = F.col(score).cast("double")
    bad = s.isNull() | F.isnan(s) | is_infinite(s)
    if probability:
        bad = bad | (s < 0) | (s > 1)
    guess = F.lit(False) if prediction is None else ~F.coalesce(F.col(prediction).cast("int").isin(0, 1), F.lit(False))
    row = df.groupBy(*keys).agg(
        F.count_if(bad).alias("scores"), F.count_if(guess).alias("guesses"),
        F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("labels"),
        F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos"),
    ).agg(F.sum("scores").alias("scores"), F.sum("guesses").alias("guesses"), F.sum("labels").alias("labels"),
          F.min(F.least("neg", "pos")).alias("smallest")).first()
    if row.labels or not row.smallest:
        raise ValidationError("Metrics target must contain both non-null classes 0 and 1")
    if row.scores:
        raise ValidationError("Probabilities must be finite values between 0 and 1" if probability
                              else "Scores must be finite")
    if row.guesses:
        raise ValidationError("Predictions must be binary values containing only 0/1")


def evaluate_models(scored: DataFrame, label: str = "label", score: str = "score", prediction: str = "alert",
                    keys: Sequence[str] = ("model_name", "split")) -> DataFrame:
    """All metrics per model and partition from one long table of scored rows."""
    counts = confusion_metrics(scored, label, prediction, keys)
    return counts.join(ranking_metrics(scored, label, score, keys), list(keys))


def evaluation_curves(scored: DataFrame, label: str = "label", score: str = "score",
                      keys: Sequence[str] = ("model_name", "split")) -> DataFrame:
    """ROC and precision-recall points in one long table: keys, curve, place, x, y."""
    roc = roc_curve(scored, label, score, keys).select(*keys, F.lit("roc").alias("curve"), "place",
                                                       F.col("fpr").alias("x"), F.col("tpr").alias("y"))
    pr = pr_curve(scored, label, score, keys).select(*keys, F.lit("pr").alias("curve"), "place",
                                                     F.col("recall").alias("x"), F.col("precision").alias("y"))
    return roc.unionByName(pr)


def decision_rule(score_kind: str, threshold: float | None = None, model: str = "Isolation Forest") -> str:
    """Text describing how alerts were decided."""
    if score_kind == "probability":
        return f"probability >= {float(threshold):.4g} (fixed)"
    return f"{model} native predict cutoff (contamination=auto)"

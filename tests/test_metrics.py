import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.operators import metrics


def plain_curves(y, s):
    """Cumulative counts at distinct scores, high to low, in plain NumPy."""
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    ends = np.r_[np.flatnonzero(np.diff(s)), len(s) - 1]
    tp = np.cumsum(y)[ends]
    return tp, ends + 1 - tp, s[ends]


def example(spark, n=400, levels=25, partitions=1):
    random = np.random.default_rng(3)
    s = np.round(random.random(n), 3) if levels is None else random.integers(0, levels, n) / levels
    y = (random.random(n) < 0.2 + 0.5 * s).astype(int)
    rows = [("m", int(a), float(b)) for a, b in zip(y, s)]
    return y, s, spark.createDataFrame(rows, "model_name string, y int, s double").repartition(partitions)


@pytest.mark.parametrize("levels, partitions", [(25, 1), (None, 17), (1, 4)])
def test_ranking_and_curves_match_numpy(spark, levels, partitions):
    y, s, df = example(spark, levels=levels, partitions=partitions)
    tp, fp, thresholds = plain_curves(y, s)
    p, n = y.sum(), len(y) - y.sum()
    row = metrics.ranking_metrics(df, "y", "s").first()
    tpr, fpr = np.r_[0, tp / p], np.r_[0, fp / n]
    assert row.roc_auc == pytest.approx(np.trapezoid(tpr, fpr), abs=1e-12)
    assert row.pr_auc == pytest.approx(np.sum(np.diff(np.r_[0, tp]) / p * tp / (tp + fp)), abs=1e-12)

    roc = metrics.roc_curve(df, "y", "s").orderBy("place").collect()
    keep = np.r_[True, np.diff(fp, 2).astype(bool) | np.diff(tp, 2).astype(bool), True] if len(tp) > 2 else np.ones(len(tp), bool)
    np.testing.assert_allclose([r.fpr for r in roc], np.r_[0, fp[keep] / n])
    np.testing.assert_allclose([r.tpr for r in roc], np.r_[0, tp[keep] / p])

    pr = metrics.pr_curve(df, "y", "s", ["model_name"]).orderBy(F.desc("place")).collect()
    np.testing.assert_allclose([r.precision for r in pr], np.r_[(tp / (tp + fp))[::-1], 1])
    np.testing.assert_allclose([r.recall for r in pr], np.r_[(tp / p)[::-1], 0])
    assert [r.threshold for r in pr[:-1]] == thresholds[::-1].tolist()


# Published confusion counts (TN, FP, FN, TP) with precision, recall and F1.
@pytest.mark.parametrize("counts, expected", [
    ((41737, 929, 4, 52), (0.053007, 0.928571, 0.100289)),
    ((42666, 0, 16, 40), (1.0, 0.714286, 0.833333)),
    ((42626, 43, 13, 39), (0.475610, 0.750000, 0.582090)),
    ((41101, 1568, 15, 37), (0.023053, 0.711538, 0.044659)),
])
def test_confusion_goldens(spark, counts, expected):
    parts = [spark.range(c).select(F.lit(y).alias("y"), F.lit(p).alias("p")) for c, (y, p) in zip(counts, ((0, 0), (0, 1), (1, 0), (1, 1)))]
    df = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    row = metrics.confusion_metrics(df, "y", "p").first()
    assert (row.true_negative, row.false_positive, row.false_negative, row.true_positive) == counts
    assert tuple(round(v, 6) for v in (row.precision, row.recall, row.f1)) == expected


def test_zero_division_and_guards(spark):
    df = spark.createDataFrame([(0, 0.1, 0), (1, 0.2, 0)], "y int, s double, p int")
    row = metrics.confusion_metrics(df, "y", "p").first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)
    metrics.require_scores(df, "y", "s", "p", probability=True)
    for change, probability, message in (
        ({"s": F.lit(1.5)}, True, "between 0 and 1"), ({"s": F.lit(float("inf"))}, False, "finite"),
        ({"y": F.lit(1)}, False, "both non-null"), ({"p": F.lit(2)}, False, "binary"), ({"y": F.lit(None).cast("int")}, False, "both"),
    ):
        with pytest.raises(ValidationError, match=message):
            metrics.require_scores(df.withColumns(change), "y", "s", "p", probability=probability)


def test_models_and_partitions_are_evaluated_together(spark):
    _, _, df = example(spark)
    both = df.withColumns({"split": F.lit("test"), "p": (F.col("s") >= 0.5).cast("int")})
    both = both.unionByName(both.withColumns({"model_name": F.lit("flipped"), "s": 1 - F.col("s")}))
    rows = {r.model_name: r for r in metrics.evaluate_models(both, "y", "s", "p").collect()}
    assert rows["m"].roc_auc + rows["flipped"].roc_auc == pytest.approx(1.0)
    curves = metrics.evaluation_curves(both, "y", "s")
    assert {r.curve for r in curves.select("curve").distinct().collect()} == {"roc", "pr"}
    assert metrics.decision_rule("probability", 0.5) == "probability >= 0.5 (fixed)"

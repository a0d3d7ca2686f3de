import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.operators import features, models, optimum, scoring
from riskloom.sinks import bundle


def rows_of(x, y):
    return [([float(v) for v in row], float(label)) for row, label in zip(x, y)]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = (x @ [1.5, -0.5, 0.0] + rng.logistic(size=600) > 1).astype(int)
    df = spark.createDataFrame(rows_of(x, y), "x array<double>, label double").repartition(5)
    counts = {0: int((y == 0).sum()), 1: int((y == 1).sum())}
    return x, y, models.Training(df.select(array_to_vector("x").alias("features"), "label"), counts, ("a", "b", "c"))


def plain(x, y, point):
    """Objective and gradient over the whole sample in one piece."""
    full, w = np.column_stack([x, np.ones(len(x))]), np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    p, penalty = 1 / (1 + np.exp(-(full @ point))), np.array([1, 1, 1, 0]) / len(x)
    return -(w * np.log(np.where(y == 1, p, 1 - p))).sum() + (penalty * point**2).sum() / 2, full.T @ (w * (p - y)) + penalty * point


def test_certificate_equals_a_plain_version(sample):
    x, y, training = sample
    for point in ([0, 0, 0, 0], [1.0, -2.0, 0.5, 0.25]):
        objective, gradient = plain(x, y, np.array(point, float))
        found = optimum.certificate(training, point[:3], point[3])
        assert found.objective == pytest.approx(objective, abs=1e-12) and found.hessian is None and not found.optimal
        np.testing.assert_allclose(found.gradient, gradient, atol=1e-12)


def test_polish_ends_at_the_optimum_from_anywhere(sample):
    x, y, training = sample
    fit = models.fit_logistic(training)
    near, proof = optimum.polish(training, fit.coefficients.toArray(), float(fit.intercept))
    far, _ = optimum.polish(training, [8.0, 8.0, -8.0], 5.0)
    np.testing.assert_allclose([*near.weights, near.intercept], [*far.weights, far.intercept], atol=1e-8)
    np.testing.assert_allclose(near.weights, fit.coefficients.toArray(), atol=1e-3)
    assert proof.optimal and proof.objective <= optimum.certificate(training, fit.coefficients.toArray(), float(fit.intercept)).objective + 1e-12
    with pytest.raises(ValidationError, match="did not reach"):
        optimum.polish(training, [8.0, 8.0, -8.0], 5.0, steps=1)


def test_model_scores_alike_in_columns_numpy_and_bundles(spark, sample, tmp_path):
    x, y, training = sample
    model, _ = optimum.polish(training, [0.0, 0.0, 0.0], 0.0)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id int, a double, b double, c double")
    scorer = scoring.ProbabilityScorer("optimal", model, features.fit_features(df, ["a", "b", "c"]))
    path = bundle.save_bundle(spark, str(tmp_path / "kept"), scorer, dataset_id="d", split_strategy="none", train_rows=600, target="y")
    loaded, manifest = bundle.load_bundle(spark, path)
    assert manifest["model_type"] == "LogisticModel" and loaded.model == model
    scored = scoring.score_batch(df, loaded, ["id"]).orderBy("id").toPandas()
    prepared = (x - x.mean(axis=0)) / x.std(axis=0)
    np.testing.assert_allclose(scored.score, loaded.evaluator()(prepared), atol=1e-9)
    with pytest.raises(ValidationError, match="one intercept"):
        optimum.model_from_weights(model.weight_frame(spark).where(F.col("position") >= 0).collect())

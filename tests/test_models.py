import math

from unittest.mock import MagicMock

import numpy as np
import pytest
from conftest import NAMES, modular_toy, wide_frame
from pyspark.sql import Observation, functions as F

from riskloom.errors import ValidationError
from riskloom.operators import evaluate, features, iforest, metrics, models, percentiles, scoring
from riskloom.sinks import bundle, tables as sink
from riskloom.sources import stored


@pytest.fixture(scope="module")
def prepared(spark):
    out, state = features.prepare_wide(wide_frame(
        spark, 400, lambda r: (r // 4, r % 31, lambda i: math.cos(r / (i + 2)), r % 20 == 0)))
    return out.repartition(4).cache(), state


@pytest.fixture(scope="module")
def logistic(prepared):
    return models.fit_logistic(models.training_rows(*prepared, "Class"))


def test_logistic_reaches_the_penalised_optimum(spark, prepared, logistic):
    out, state = prepared
    train = features.transform_features(out.where("split = 'train'"), state, ["Class"]).toPandas()
    x, y = train[state.names].to_numpy(), train["Class"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, b = logistic.coefficients.toArray(), logistic.intercept
    p = 1 / (1 + np.exp(-(x @ beta + b)))
    assert np.abs(x.T @ (w * (p - y)) + beta).max() < 1e-2 and abs(np.sum(w * (p - y))) < 1e-2


def test_holdout_changes_leave_the_fit_alone(prepared, logistic):
    out, state = prepared
    flipped = out.withColumns({
        "Class": F.when(F.col("split") == "train", F.col("Class")).otherwise(1 - F.col("Class")),
        "V1": F.when(F.col("split") == "train", F.col("V1")).otherwise(F.col("V1") * 1000)})
    again = models.fit_logistic(models.training_rows(flipped, state, "Class"))
    np.testing.assert_allclose(again.coefficients.toArray(), logistic.coefficients.toArray(), rtol=1e-6)


def test_trees_are_deterministic_and_need_both_classes(prepared):
    out, state = prepared
    rows = models.training_rows(out, state, "Class")
    small = {"trees": 5, "depth": 4}
    a, b = models.fit_forest(rows, **small), models.fit_forest(rows, **small)
    np.testing.assert_array_equal(a.threshold, b.threshold)
    assert len(models.fit_boosting(rows, rounds=3, depth=2).roots) == 3
    with pytest.raises(ValidationError, match="both classes"):
        models.training_rows(out.withColumn("Class", F.lit(0)), state, "Class")


def test_logistic_scores_in_a_session_that_has_observed_metrics(spark, prepared):
    out, state = prepared
    seen = Observation()
    out.observe(seen, F.count("*").alias("n")).count()
    assert seen.get["n"] == 400
    model = models.fit_logistic(models.training_rows(out, state, "Class"))
    assert scoring.score_batch(out, scoring.ProbabilityScorer("logistic", model, state), ["Class"]).where("raw_score between 0 and 1").count() == 400


def test_probability_scores_bands_and_alerts(prepared, logistic):
    out, state = prepared
    scorer = scoring.ProbabilityScorer("logistic", logistic, state, policy=scoring.BandPolicy(25, 65))
    rows = scoring.score_batch(out, scorer, ["Time", "split", "Class"]).toPandas()
    assert len(rows) == 400 and rows.score.between(0, 100).all()
    np.testing.assert_allclose(rows.score, rows.raw_score * 100)
    assert (rows.model_alert == (rows.raw_score >= 0.5)).all()
    assert set(rows.score_basis) == {"uncalibrated model probability × 100"}
    assert set(rows.decision_method) == {"positive-class probability >= 0.5"}
    assert (rows.risk_level == np.where(rows.score < 25, "low", np.where(rows.score < 65, "medium", "high"))).all()


def test_scorer_contract(spark, prepared, logistic, forest):
    out, state = prepared
    empty = percentiles.build_index(spark.createDataFrame([], "raw_score double"), "raw_score")
    broken = percentiles.build_index(spark.createDataFrame([(0.5,), (None,)], "raw_score double"), "raw_score")
    for make, message in (
        (lambda: scoring.ProbabilityScorer("m", logistic, state, threshold=1.5), "threshold"),
        (lambda: scoring.ProbabilityScorer(" ", logistic, state), "a name"),
        (lambda: scoring.ProbabilityScorer("m", object(), state), "two classes"),
        (lambda: scoring.ProbabilityScorer("m", logistic, features.FeatureState(state.numeric[:2])), "these features"),
        (lambda: scoring.ProbabilityScorer("m", logistic, features.FeatureState(state.numeric + state.numeric[:1])), "distinct features"),
        (lambda: scoring.AnomalyScorer("m", forest, state, empty), "reference scores"),
        (lambda: scoring.AnomalyScorer("m", forest, state, broken), "finite reference scores"),
        (lambda: scoring.AnomalyScorer("m", logistic, state, broken), "a forest of these features"),
    ):
        with pytest.raises(ValidationError, match=message):
            make()
    with pytest.raises(ValidationError, match="Risk bands"):
        scoring.BandPolicy(70, 30)


@pytest.fixture(scope="module")
def forest(prepared):
    out, state = prepared
    train = features.transform_features(out.where("split = 'train'").withColumn("row", F.monotonically_increasing_id()), state, ["Time", "Amount"])
    keyed = features.transform_features(
        out.where("split = 'train'").withColumn("row", F.concat_ws("/", "Time", "Amount", "V1")), state, ["row"])
    assert train.count() == keyed.count()
    return iforest.fit_isolation_forest(keyed, "row", state.names, trees=20, sample=64)


def test_forest_shape_and_repeatability(prepared, forest):
    out, state = prepared
    keyed = features.transform_features(
        out.where("split = 'train'").withColumn("row", F.concat_ws("/", "Time", "Amount", "V1")), state, ["row"])
    again = iforest.fit_isolation_forest(keyed.repartition(7), "row", state.names, trees=20, sample=64)
    np.testing.assert_array_equal(again.threshold, forest.threshold)
    np.testing.assert_array_equal(again.below, forest.below)
    assert len(forest.roots) == 20 and len(forest.feature) <= 20 * (2 * 64 - 1)
    inner = forest.feature >= 0
    assert (forest.below[inner] > 0).all() and (forest.path[~inner] > 0).all()


def test_forest_scores_follow_the_path_formula(spark, forest):
    def score(row):
        lengths = []
        for root in forest.roots:
            at = root
            while forest.feature[at] >= 0:
                at = forest.below[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.above[at]
            lengths.append(forest.path[at])
        return 2 ** (-np.mean(lengths) / iforest.average_path(forest.sample))

    random = np.random.default_rng(1)
    rows = random.normal(size=(50, 30))
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in NAMES))
    got = df.select(forest.score([F.col(n) for n in NAMES]).alias("s"), "*").toPandas()
    np.testing.assert_allclose(got.s, [score(r) for r in got[NAMES].to_numpy()])
    far = df.select(forest.score([F.lit(50.0)] * 30).alias("s")).first().s
    assert far > got.s.max() and 0 < far < 1


def test_average_path_values():
    assert [iforest.average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert iforest.average_path(256) == pytest.approx(2 * (math.log(255) + np.euler_gamma) - 2 * 255 / 256)


def test_anomaly_percentiles_are_ranks_in_the_reference(spark, prepared, forest):
    out, state = prepared
    train = out.where("split = 'train'")
    reference = scoring.training_reference(forest, train, state)
    scorer = scoring.AnomalyScorer("forest", forest, state, reference)
    assert scorer.reference_rows == 280 and scorer.threshold is None
    rows = scoring.score_batch(out, scorer, ["Time", "Amount"]).toPandas()
    table = reference.table().toPandas()
    ordered = np.sort(np.repeat(table.score, table.reference_rows))
    np.testing.assert_allclose(rows.score, np.searchsorted(ordered, rows.raw_score, side="right") / 280 * 100)
    assert (rows.model_alert == (rows.raw_score > 0.5)).all()
    new = spark.createDataFrame([(i, float(v)) for i, v in enumerate([-1.0, *ordered[::40], 0.5, 2.0, ordered[3], ordered[3]])], "id int, raw_score double")
    new = new.unionByName(spark.createDataFrame([(90, None), (91, float("nan"))], "id int, raw_score double"))
    by_rank = reference.percentiles(new, "raw_score").toPandas()
    assert by_rank[by_rank.id >= 90].percentile.isna().all()
    by_rank = by_rank[by_rank.id < 90]
    np.testing.assert_allclose(by_rank.percentile, np.searchsorted(ordered, by_rank.raw_score, side="right") / 280 * 100)


def test_labels_never_reach_the_forest(prepared, forest):
    out, state = prepared
    keyed = features.transform_features(
        out.withColumn("Class", F.lit(1)).where("split = 'train'").withColumn("row", F.concat_ws("/", "Time", "Amount", "V1")), state, ["row"])
    np.testing.assert_array_equal(iforest.fit_isolation_forest(keyed, "row", state.names, trees=20, sample=64).threshold, forest.threshold)


def test_evaluation_is_stored_and_read_back(spark, tmp_path, prepared, logistic, forest):
    out, state = prepared
    first = scoring.ProbabilityScorer("logistic", logistic, state)
    second = scoring.AnomalyScorer("forest", forest, state, scoring.training_reference(forest, out.where("split = 'train'"), state))
    report, curves = evaluate.compare_scorers(out, "Class", [first, second])
    assert {r.decision_rule for r in report.collect()} == {
        "probability >= 0.5 (fixed)", "Isolation Forest native predict cutoff (contamination=auto)"}
    with pytest.raises(ValidationError, match="unique"):
        evaluate.check_scorers([first, first])
    with pytest.raises(ValidationError, match="no scorer"):
        evaluate.check_scorers([])
    report = report.drop("score_kind", "decision_rule")
    rules = {"logistic": ("probability", metrics.decision_rule("probability", 0.5)), "forest": ("anomaly", metrics.decision_rule("anomaly"))}
    paths = sink.write_evaluation(report, curves, str(tmp_path / "evaluation"), rules)
    view = stored.read_performance(spark, paths["metrics"], "test")
    assert view.count() == 2 and {r.row_count for r in view.collect()} == {60}
    with pytest.raises(ValidationError, match="validation or test"):
        stored.read_performance(spark, paths["metrics"], "train")
    with pytest.raises(ValidationError, match="unavailable"):
        stored.read_performance(spark, str(tmp_path / "none"), "test")
    for config, run in (({"c": "1"}, "first"), ({}, "second"), ({"c": "1"}, "first")):
        sink.append_baseline(report, str(tmp_path / "baselines"), config, run)
    assert spark.read.parquet(str(tmp_path / "baselines")).count() == 8
    broken = spark.read.parquet(paths["metrics"]).withColumn("f1", F.lit(1.5))
    broken.write.partitionBy("split").parquet(str(tmp_path / "broken"))
    with pytest.raises(ValidationError, match="out-of-range"):
        stored.read_performance(spark, str(tmp_path / "broken"), "test")


@pytest.mark.parametrize("kind", ["probability", "anomaly"])
def test_bundles_round_trip_and_are_immutable(spark, tmp_path, prepared, logistic, forest, kind):
    out, state = prepared
    train = out.where("split = 'train'")
    scorer = scoring.ProbabilityScorer("kept", logistic, state) if kind == "probability" else scoring.AnomalyScorer(
        "kept", forest, state, scoring.training_reference(forest, train, state))
    path = str(tmp_path / kind)
    details = {"dataset_id": "wide", "split_strategy": "chronological 70/15/15", "train_rows": 280}
    bundle.save_bundle(spark, path, scorer, **details)
    loaded, manifest = bundle.load_bundle(spark, path)
    assert manifest["feature_names"] == state.names and manifest["train_rows"] == 280

    def scores(s):
        return scoring.score_batch(out, s, ["Time", "Amount"]).orderBy("Time", "Amount").toPandas().score

    np.testing.assert_allclose(scores(loaded), scores(scorer))
    with pytest.raises(ValidationError, match="immutable"):
        bundle.save_bundle(spark, path, scorer, **details)
    with pytest.raises(ValidationError, match="missing"):
        bundle.load_bundle(spark, str(tmp_path / "none"))
    with pytest.raises(ValidationError, match="dataset_id"):
        bundle.save_bundle(spark, str(tmp_path / "x"), scorer, **(details | {"dataset_id": "/data/x"}))
    for field, value in (("score_basis", "other"), ("decision_threshold", 3.0 if kind == "probability" else 0.5), ("feature_names", [])):
        with pytest.raises(ValidationError):
            bundle.check_manifest(manifest | {field: value})


def test_modular_toy_chain(spark):
    out, state = features.prepare_wide(modular_toy(spark, 240, 4))
    model = models.fit_logistic(models.training_rows(out, state, "Class"))
    scorer = scoring.ProbabilityScorer("toy", model, state)
    scored = scoring.score_batch(out.where("split <> 'train'"), scorer, ["split", "Class"])
    rows = {r.split: r.row_count for r in metrics.evaluate_models(scored, "Class", "raw_score", "model_alert").collect()}
    assert rows == {"validation": 36, "test": 36}


def test_registered_model_queries_use_the_defaults(monkeypatch):
    from riskloom.plans import score

    calls = []
    note = lambda name: lambda *a, **k: calls.append((name, k))
    for name in ("evaluate_models", ):
        monkeypatch.setattr(score.metrics, name, note(name))
    for name in ("_prepared_lines", "prepared_orders"):
        monkeypatch.setattr(score, name, lambda *_: (MagicMock(), MagicMock()))
    for module, names in ((score, ["transform_features", "cut_lineage", "bottom_by_digest"]), (score.models, ["training_rows", "fit_logistic"]),
                          (score.scoring, ["training_reference", "score_batch", "ProbabilityScorer", "AnomalyScorer"]), (score.evaluate, ["compare_scorers"]), (score.explain, ["background_rows"])):
        for name in names:
            monkeypatch.setattr(module, name, MagicMock())
    monkeypatch.setattr(score.F, "col", MagicMock())
    monkeypatch.setattr(score.iforest, "fit_isolation_forest", note("isolation"))
    monkeypatch.setattr(score.models, "fit_boosting", note("boosting"))
    monkeypatch.setattr(score.investigate, "investigate", note("investigate"))
    monkeypatch.setattr(score.models, "FITTERS", {"random_forest": note("forest"), "gradient_boosting": note("boosting")})
    for query in ("random_forest", "gbt", "isolation_forest", "model_comparison", "investigation"):
        score.QUERIES[query](None, "")
    given = [(name, sorted(k)) for name, k in calls if name != "evaluate_models"]
    assert given == [("forest", []), ("boosting", []), ("isolation", ["seed"]), ("isolation", ["seed"]), ("boosting", []), ("investigate", ["amount", "time"])]
    assert score.bottom_by_digest.call_args.args[2] == score.explain.MAX_BACKGROUND_ROWS


def test_trees_draw_from_the_whole_training_part():
    draws, distinct = iforest._draws(10**9, 20, 64, 42)
    assert distinct == 20 * 64 and sorted(draws["place"]) == list(range(20 * 64))  # so many rows of a large table are never shared
    draws, distinct = iforest._draws(300, 20, 64, 42)
    assert 64 < distinct <= 300 and draws["place"].max() == distinct - 1 and not draws.duplicated().any()

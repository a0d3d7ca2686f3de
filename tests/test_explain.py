import itertools
import math

import numpy as np
import pytest
from conftest import wide_frame
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.operators import explain, features, iforest, investigate, models, scoring
from riskloom.sources import stored

BACKGROUND = [[0.0, 1.0, 2.0], [1.0, -1.0, 0.5], [2.0, 0.0, -3.0], [0.5, 0.5, 0.5]]


def curved(x):
    return 50 + 10 * x[0] * x[1] - 5 * x[2] ** 2 + 3 * x[0]


def curved_rows(df):
    x = [F.col("x")[i] for i in range(3)]
    return df.withColumn("score", 50 + 10 * x[0] * x[1] - 5 * x[2] * x[2] + 3 * x[0])


def exact_shapley(case):
    """Shapley values by summing over every feature order."""
    value = {}
    for size in range(4):
        for chosen in itertools.combinations(range(3), size):
            value[chosen] = np.mean([curved([case[j] if j in chosen else row[j] for j in range(3)]) for row in BACKGROUND])
    phi = np.zeros(3)
    for order in itertools.permutations(range(3)):
        seen = ()
        for j in order:
            after = tuple(sorted((*seen, j)))
            phi[j] += (value[after] - value[seen]) / 6
            seen = after
    return value[()], phi


def test_matches_exact_shapley_when_every_order_is_drawn(spark):
    seed = next(s for s in range(200) if len({tuple(o) for o in drawn_orders(3, 21, s)}) == 6)
    cases = [(1, 1.0, 2.0, 3.0), (2, -1.0, 0.5, 0.0), (3, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(cases, "id int, a double, b double, c double")
    rows = explain.shapley_values(df, "id", ["a", "b", "c"], BACKGROUND, curved_rows, max_evals=21, seed=seed).orderBy("id").collect()
    for row, case in zip(rows, cases):
        base, phi = exact_shapley(case[1:])
        np.testing.assert_allclose(row.shap, phi, atol=1e-9)
        assert row.baseline_score == pytest.approx(base) and row.score == pytest.approx(curved(case[1:])) and row.additive


def drawn_orders(m, max_evals, seed):
    random = np.random.default_rng(seed)
    orders = []
    for _ in range(max_evals // (2 * m + 1)):
        order = random.permutation(m)
        orders += [order, order[::-1]]
    return orders


def test_additive_for_any_draw_and_partitioning(spark):
    df = spark.range(40).selectExpr("id", "CAST(id % 7 AS double) AS a", "CAST(id % 5 AS double) AS b", "id / 10D AS c")
    results = [
        {r.id: tuple(r.shap) for r in explain.shapley_values(
            df.repartition(p), "id", ["a", "b", "c"], BACKGROUND, curved_rows, max_evals=7, partitions=p).where("additive").collect()}
        for p in (1, 17)]
    assert len(results[0]) == 40
    for key, value in results[0].items():
        np.testing.assert_allclose(value, results[1][key], atol=1e-9)


def test_coalition_weights_balance():
    for m, evals in ((3, 21), (30, 61), (5, 100)):
        weights = explain.coalition_weights(m, evals, 1)
        np.testing.assert_allclose(sum(weights.values()), np.zeros(m), atol=1e-12)
        np.testing.assert_allclose(weights[(True,) * m].sum(), 1.0)


@pytest.mark.parametrize("evals, background, message", [
    (6, BACKGROUND, "max_evals"), (10_001, BACKGROUND, "max_evals"), (21, [], "background"), (21, BACKGROUND * 26, "background")])
def test_bounds(spark, evals, background, message):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "id int, a double, b double, c double")
    with pytest.raises(ValidationError, match=message):
        explain.shapley_values(df, "id", ["a", "b", "c"], background, curved_rows, max_evals=evals)


def test_background_files(spark, tmp_path):
    spark.range(8).selectExpr("CAST(id AS double) AS a", "1.5D AS b").coalesce(1).write.parquet(str(tmp_path / "ok"))
    assert len(stored.read_background(spark, str(tmp_path / "ok"), ["a", "b"])) == 8
    for name, rows, columns in (("many", 101, ["CAST(id AS double) AS a", "1D AS b"]), ("two", 5, ["1D AS b"]),
                                ("inf", 5, ["CAST('Infinity' AS double) AS a", "1D AS b"])):
        spark.range(rows).selectExpr(*columns).write.parquet(str(tmp_path / name))
        with pytest.raises(ValidationError):
            stored.read_background(spark, str(tmp_path / name), ["a", "b"])
    (tmp_path / "b.csv").write_text("a,b\n1,2\n3,4\n")
    assert stored.read_background(spark, str(tmp_path / "b.csv"), ["a", "b"]) == [[1.0, 2.0], [3.0, 4.0]]


def test_top_contributors(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate([1.0, -5.0, 5.0, 0.5])] + [("d", 0, 2.0)], "case string, i int, v double")
    rows = explain.top_contributors(df, "case", F.col("v"), ["i"], 2).orderBy("case", "place").collect()
    assert [(r.case, r.i) for r in rows] == [("c", 1), ("c", 2), ("d", 0)]
    plan = explain.top_contributors(df, "case", F.col("v"), ["i"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("kind", ["probability", "anomaly"])
def test_investigation_records(spark, kind):
    out, state = features.prepare_wide(wide_frame(
        spark, 400, lambda r: (r // 4, r % 31, lambda i: math.cos(r / (i + 2)), r % 20 == 0)))
    train = features.transform_features(out.where("split = 'train'").withColumn("row", F.concat_ws("/", "Time", "Amount", "V1")), state, ["row"])
    if kind == "probability":
        scorer = scoring.ProbabilityScorer("m", models.fit_logistic(models.training_rows(out, state, "Class")), state)
    else:
        forest = iforest.fit_isolation_forest(train, "row", state.names, trees=10, sample=32)
        scorer = scoring.AnomalyScorer("m", forest, state, scoring.training_reference(forest, out.where("split = 'train'"), state))
    background = explain.background_rows(explain.background_sample(train, "row", 8), state.names)
    cases = out.where("split = 'test'").limit(5).withColumn("case", F.concat(F.lit(" case-"), F.monotonically_increasing_id())).cache()
    records = investigate.require_agreement(investigate.investigate(cases, "case", scorer, background, max_evals=61, top=3)).collect()
    assert len(records) == 5 and {r.transaction_id[:5] for r in records} == {"case-"}
    for r in records:
        names = [a.feature_name for a in r.explanation.attributions]
        assert names == state.names and r.prediction.score_kind == kind
        total = r.explanation.baseline_score + sum(a.shap_value for a in r.explanation.attributions)
        assert total == pytest.approx(r.prediction.score, abs=1e-4)
        best = sorted(r.explanation.attributions, key=lambda a: -abs(a.shap_value))[:3]
        assert [a.feature_name for a in r.top_contributors] == [a.feature_name for a in best]
    with pytest.raises(ValidationError, match="top_contributors"):
        investigate.investigate(cases, "case", scorer, background, top=31)
    with pytest.raises(ValidationError, match="61 to"):
        investigate.investigate(cases, "case", scorer, background, max_evals=60)


def test_blocks_equal_the_expanded_frame(spark):
    random = np.random.default_rng(5)
    cases = spark.createDataFrame([(f"c{i}", *map(float, random.normal(size=3))) for i in range(700)], "id string, a double, b double, c double").repartition(3)
    background = random.normal(size=(7, 3)).tolist()
    weights = np.array([0.7, -1.1, 0.4])
    expected = explain.shapley_values(cases, "id", ["a", "b", "c"], background, lambda df: df.withColumn("score", 100 / (1 + F.exp(-(0.7 * F.col("x")[0] - 1.1 * F.col("x")[1] + 0.4 * F.col("x")[2])))), max_evals=50)
    found = explain.shapley_blocks(cases, "id", ["a", "b", "c"], background, lambda x: 100 / (1 + np.exp(-(x @ weights))), max_evals=50)
    one, two = (df.select("id", "own", "score", "baseline_score", "shap", "additive").orderBy("id").toPandas() for df in (expected, found))
    assert one.id.tolist() == two.id.tolist() and two.additive.all() and one.additive.all()
    for name in ("own", "shap"):
        np.testing.assert_allclose(np.array(two[name].tolist()), np.array(one[name].tolist()), atol=1e-9)
    for name in ("score", "baseline_score"):
        np.testing.assert_allclose(two[name], one[name])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("REPARTITION")[0].split("MapInArrow")[0]
    assert explain.shapley_blocks(cases.where("false"), "id", ["a", "b", "c"], background, lambda x: x.sum(axis=1), max_evals=50).count() == 0

"""Binned trees against plain recursive versions, and fits that do not depend on how rows are dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.operators import features, models, scoring, trees
from riskloom.sinks import bundle

SETTINGS = {"rounds": 6, "depth": 4, "rate": 0.3, "share": 1.0, "columns": 1.0, "most": 1.0, "penalty": 1.0, "least": 1.0, "seed": 7}


def toy(n, m=4, seed=0):
    random = np.random.default_rng(seed)
    x = np.round(random.normal(size=(n, m)), 2)
    return x, ((x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + random.normal(scale=0.3, size=n)) > 0.4).astype(np.int64)


def frame(spark, x, y):
    rows = [(i, int(label), *map(float, row)) for i, (row, label) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id int, y int, " + ", ".join(f"c{j} double" for j in range(x.shape[1])))
    return df.withColumn("split", F.when(F.col("id") % 5 == 4, "test").otherwise("train"))


def test_codes_agree_with_cuts():
    x, _ = toy(500)
    for bins in (2, 7, 256):
        cuts = [trees.even_cuts(x[:, j], bins) for j in range(x.shape[1])]
        codes = trees.code_rows(x, cuts)
        for j, c in enumerate(cuts):
            assert len(c) < bins and (np.diff(c) > 0).all()
            for b, cut in enumerate(c):
                assert ((codes[:, j] <= b) == (x[:, j] <= cut)).all()
    assert len(trees.even_cuts(np.array([3.0, 3.0]), 8)) == 0
    assert trees.even_cuts(np.array([1.0, np.nextafter(1.0, 2)]), 8)[0] < np.nextafter(1.0, 2)


def plain_boost(x, y, weight, cuts, s):
    """Node by node, cut by cut, from the rows themselves."""
    margin = np.zeros(len(x))
    leaves = []

    def step(g, h):
        return float(np.clip(-g / (h + s["penalty"]), -s["most"], s["most"]))

    def gain(g, h):
        w = step(g, h)
        return -(2 * g * w + (h + s["penalty"]) * w * w)

    for _ in range(s["rounds"]):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        found = {}

        def grow(rows, depth):
            best = (1e-6, None, None)
            if depth < s["depth"]:
                for j, c in enumerate(cuts):
                    for cut in c:
                        left = rows[x[rows, j] <= cut]
                        right = rows[x[rows, j] > cut]
                        if h[left].sum() < s["least"] or h[right].sum() < s["least"]:
                            continue
                        better = gain(g[left].sum(), h[left].sum()) + gain(g[right].sum(), h[right].sum()) - gain(g[rows].sum(), h[rows].sum())
                        if better > best[0] + 1e-9:
                            best = (better, j, cut)
            if best[1] is None:
                found[tuple(rows)] = s["rate"] * step(g[rows].sum(), h[rows].sum())
            else:
                grow(rows[x[rows, best[1]] <= best[2]], depth + 1)
                grow(rows[x[rows, best[1]] > best[2]], depth + 1)

        grow(np.arange(len(x)), 0)
        for rows, value in found.items():
            margin[list(rows)] += value
        leaves.append(sorted(found.values()))
    return margin, leaves


def test_boosting_equals_a_plain_version_on_2000_rows():
    x, y = toy(2000)
    cuts = [trees.even_cuts(x[:, j], 12) for j in range(x.shape[1])]
    weight = np.where(y == 1, 3.0, 1.0)
    nodes = trees.boost(trees.code_rows(x, cuts), y, weight, np.ones(len(x), np.int64), cuts, **SETTINGS)
    margin, leaves = plain_boost(x, y, weight, cuts, SETTINGS)
    for tree in range(SETTINGS["rounds"]):
        np.testing.assert_allclose(sorted(n[5] for n in nodes if n[0] == tree and n[2] < 0), leaves[tree], rtol=1e-9)
    import pandas as pd
    model = trees.ensemble_from_nodes(pd.DataFrame(nodes, columns=trees._NODE_NAMES), list("abcd"), "boosting")
    np.testing.assert_allclose(model.predict(x), 1 / (1 + np.exp(-margin)), rtol=1e-9)
    assert max(abs(n[5]) for n in nodes) <= SETTINGS["rate"] * SETTINGS["most"] + 1e-12


def test_best_split_equals_a_search_over_all_cuts():
    x, y = toy(300, 3, 4)
    cuts = [trees.even_cuts(x[:, j], 30) for j in range(3)]
    codes = trees.code_rows(x, cuts)
    random = np.random.default_rng(2)
    weight = random.integers(1, 4, 300).astype(float)
    w0, w1, node = np.where(y == 0, weight, 0.0), np.where(y == 1, weight, 0.0), random.integers(0, 4, 300)
    feature, cut = trees._best_splits(codes, node, 4, w0, w1, np.ones(300), 5, np.ones((4, 3), bool))

    def purity(at, j, b):
        total = 0.0
        for side in (codes[at, j] <= b, codes[at, j] > b):
            if side.sum() < 5:
                return -np.inf
            a, c = w0[at][side].sum(), w1[at][side].sum()
            total += (a * a + c * c) / (a + c)
        return total

    for k in range(4):
        at = np.flatnonzero(node == k)
        best = max(purity(at, j, b) for j in range(3) for b in range(len(cuts[j])))
        assert purity(at, feature[k], cut[k]) == pytest.approx(best)


def test_forest_trees_respect_their_settings():
    x, y = toy(400, 4, 9)
    cuts = [trees.even_cuts(x[:, j], 64) for j in range(4)]
    nodes = trees.grow_tree(trees.code_rows(x, cuts), y, np.ones(400, np.int64), cuts, depth=5, least=3, share=0.8, tries=2, random=np.random.default_rng(1))
    by_node = {n[0]: n for n in nodes}
    assert sorted(by_node) == list(range(len(nodes)))

    def depth(i):
        return 0 if by_node[i][1] < 0 else 1 + max(depth(by_node[i][3]), depth(by_node[i][3] + 1))

    assert depth(0) <= 5 and all(0 <= n[4] <= 1 for n in nodes) and by_node[0][4] == pytest.approx(0.5)
    single = trees.grow_tree(np.zeros((4, 1), np.uint8), np.zeros(4, np.int64), np.ones(4, np.int64), [np.empty(0)], depth=3, least=1, share=1.0, tries=1, random=np.random.default_rng(0))
    assert single == [(0, -1, 0.0, -1, 0.0)]


@pytest.mark.parametrize("fit,small", [(models.fit_forest, {"trees": 12, "depth": 6}), (models.fit_boosting, {"rounds": 80})])
def test_fits_repeat_however_rows_are_dealt_and_learn(spark, tmp_path, fit, small):
    x, y = toy(1500)
    x[:400], y[:400] = x[0], 0  # a third of the rows are one
    df = frame(spark, x, y)
    state = features.fit_features(df.where("split = 'train'"), [f"c{j}" for j in range(4)])
    one = fit(models.training_rows(df.repartition(1), state, "y"), **small)
    two = fit(models.training_rows(df.repartition(7, "id"), state, "y"), **small)
    for name in ("roots", "feature", "threshold", "below", "value"):
        np.testing.assert_array_equal(getattr(one, name), getattr(two, name))
    scorer = scoring.ProbabilityScorer("trees", one, state)
    scored = scoring.score_batch(df.where("split = 'test'"), scorer, ["id", "y"]).toPandas()
    unseen = scored[scored.id >= 400]
    assert ((unseen.raw_score >= 0.5) == (unseen.y == 1)).mean() > 0.75
    plain = features.transform_features(df.where("split = 'test'"), state, ["id"]).toPandas().set_index("id").loc[scored.id]
    np.testing.assert_allclose(scored.raw_score, one.predict(plain[state.names].to_numpy()))
    bundle.save_bundle(spark, str(tmp_path / "b"), scorer, dataset_id="toy", split_strategy="fifths", train_rows=1200)
    loaded, _ = bundle.load_bundle(spark, str(tmp_path / "b"))
    np.testing.assert_array_equal(loaded.model.value, one.value)
    assert loaded.model.kind == one.kind
    changed = df.withColumn("y", F.when(F.col("split") == "train", F.col("y")).otherwise(1 - F.col("y")))
    np.testing.assert_array_equal(fit(models.training_rows(changed, state, "y"), **small).threshold, one.threshold)
    bounded = fit(models.training_rows(df, state, "y"), rows_per_class=100, **small)
    assert len(bounded.roots) == len(one.roots) and len(bounded.feature) <= len(one.feature)


def test_settings_out_of_range(spark):
    x, y = toy(60)
    df = frame(spark, x, y)
    state = features.fit_features(df, ["c0", "c1"])
    rows = models.training_rows(df, state, "y")
    for fit, wrong in ((models.fit_forest, {"trees": 0}), (models.fit_forest, {"bins": 300}), (models.fit_boosting, {"rounds": 0}), (models.fit_boosting, {"share": 0})):
        with pytest.raises(ValidationError, match="out of range"):
            fit(rows, **wrong)

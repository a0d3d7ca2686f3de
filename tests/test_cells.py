"""Cuts and cells of whole training parts against plain versions, trees on more rows than are gathered one by one, stored forests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import cells, features, forests, models, scoring, trees
from riskloom.operators.models import BOOSTING
from riskloom.sinks import bundle


def rows_of(spark, x, y):
    df = spark.createDataFrame([(*map(float, row), int(label)) for row, label in zip(x, y, strict=True)], ", ".join(f"c{j} double" for j in range(x.shape[1])) + ", label int")
    return df.select(F.array(*[f"c{j}" for j in range(x.shape[1])]).alias("x"), "label").repartition(5)


@pytest.mark.parametrize("bins", [4, 16, 256])
def test_cuts_and_cells_are_those_of_all_rows(spark, bins):
    random = np.random.default_rng(bins)
    x = np.column_stack([random.normal(size=3000), random.integers(0, 12, 3000), np.round(random.exponential(size=3000), 1), np.where(random.random(3000) < 0.8, 0.0, random.normal(size=3000)),
                         np.full(3000, 2.5), *random.integers(0, 3, (5, 3000))])
    y = random.integers(0, 2, 3000)
    rows = rows_of(spark, np.concatenate([x, x[:500]]), np.concatenate([y, y[:500]]))
    cuts = cells.grid_cuts(rows, 10, 3500, bins)
    for j, cut in enumerate(cuts):
        np.testing.assert_array_equal(cut, trees.even_cuts(np.concatenate([x, x[:500]])[:, j], bins))
    codes, label, copies = cells.count_cells(rows, cuts)
    plain, times = np.unique(np.column_stack([trees.code_rows(np.concatenate([x, x[:500]]), cuts), np.concatenate([y, y[:500]])]), axis=0, return_counts=True)
    np.testing.assert_array_equal(np.column_stack([codes, label]), plain)
    np.testing.assert_array_equal(copies, times)


def test_boosting_counts_every_row_of_a_large_class(spark):
    """50,000 rows, of which a bound of 20,000 a class left most out: both leaves follow from the counts of all."""
    rows = spark.range(50_000, numPartitions=4).select(F.array((F.col("id") % 1000).cast("double")).alias("x"), (F.col("id") % 1000 + F.col("id") % 7 > 900).cast("int").alias("label"))
    value = np.arange(50_000) % 1000
    label = value + np.arange(50_000) % 7 > 900
    counts = {0: int((~label).sum()), 1: int(label.sum())}
    settings = BOOSTING | {"rounds": 1, "depth": 1, "share": 1.0, "columns": 1.0, "most": 0.0}
    model = trees.fit_boosting(rows, counts, ["a"], seed=1, **settings)
    assert model.threshold[0] in trees.even_cuts(value.astype(float), 256)
    weight = counts[0] / counts[1]
    for leaf, side in ((1, value <= model.threshold[0]), (2, value > model.threshold[0])):
        ones, zeros = weight * (label & side).sum(), (~label & side).sum()
        assert model.value[leaf] == pytest.approx(0.05 * (ones - zeros) / 2 / ((ones + zeros) / 4 + 1.0), rel=1e-12)


def test_forests_count_every_row_of_a_large_class(spark):
    """A bound of 20,000 rows a class left most of 50,000 out."""
    rows = spark.range(50_000, numPartitions=4).select(F.array((F.col("id") % 10_000).cast("double"), (F.col("id") % 3).cast("double")).alias("x"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    codes, label, copies, cuts = trees._coded_rows(rows, {0: 45_000, 1: 5_000}, 2, None, 256, 1)
    assert copies[label == 0].sum() == 45_000 and copies[label == 1].sum() == 5_000
    np.testing.assert_array_equal(cuts[0], trees.even_cuts(np.arange(50_000) % 10_000.0, 256))
    first = np.arange(50_000) % 10_000 <= cuts[0][99]
    assert copies[codes[:, 0] <= 99].sum() == first.sum()


def test_stored_forests_score_as_held_ones(spark, tmp_path, monkeypatch):
    random = np.random.default_rng(3)
    x = np.round(random.normal(size=(900, 9)), 1)
    y = (x[:, 0] * x[:, 8] + random.normal(scale=0.3, size=900) > 0.2).astype(int)
    names = [f"c{j}" for j in range(9)]
    df = spark.createDataFrame([(i, int(label), *map(float, row)) for i, (row, label) in enumerate(zip(x, y, strict=True))], "id int, y int, " + ", ".join(f"{n} double" for n in names))
    df = df.withColumn("split", F.when(F.col("id") % 5 == 4, "test").otherwise("train"))
    state = features.fit_features(df.where("split = 'train'"), names)
    monkeypatch.setattr(trees, "_ONE_BY_ONE", 100)
    rows = models.training_rows(df, state, "y")
    held = models.fit_forest(rows, trees=9, depth=8)
    monkeypatch.setattr(trees, "_HELD", 10)
    monkeypatch.setattr(forests, "_BLOCK", 60)  # several blocks of cells
    stored = models.fit_forest(rows, trees=9, depth=8)
    assert isinstance(held, trees.TreeEnsemble) and isinstance(stored, forests.StoredForest)
    again = trees.ensemble_from_nodes(stored.node_frame(df).toPandas(), stored.names, stored.kind)
    for name in ("roots", "feature", "threshold", "below", "value"):
        np.testing.assert_array_equal(getattr(held, name), getattr(again, name))

    scorer = scoring.ProbabilityScorer("forest", stored, state)
    bundle.save_bundle(spark, str(tmp_path / "b"), scorer, dataset_id="toy", split_strategy="fifths", train_rows=720)
    loaded, _ = bundle.load_bundle(spark, str(tmp_path / "b"))
    test = df.where("split = 'test'").unionAll(df.where("id = 4"))  # a row twice
    wanted = scoring.score_batch(test, scoring.ProbabilityScorer("forest", held, state), ["id", "y"]).orderBy("id").toPandas()
    for s in (scorer, loaded):
        found = scoring.score_batch(test, s, ["id", "y"]).orderBy("id").toPandas()
        assert list(found.columns) == list(wanted.columns) and list(found.id) == list(wanted.id) and len(found) == 181
        np.testing.assert_allclose(found.raw_score, wanted.raw_score, rtol=0, atol=1e-11)
    assert ((found.raw_score >= 0.5) == (found.y == 1)).mean() > 0.7
    assert scoring.score_batch(test.where("id < 0"), scorer, ["id"]).count() == 0

    test.write.parquet(str(tmp_path / "in"))
    stream = scoring.score_batch(spark.readStream.schema(test.schema).parquet(str(tmp_path / "in")), scorer, ["id"])
    stream.writeStream.format("memory").queryName("stored_forest").trigger(availableNow=True).start().awaitTermination(120)
    streamed = spark.table("stored_forest").orderBy("id").toPandas()
    np.testing.assert_allclose(streamed.raw_score, wanted.raw_score, rtol=0, atol=1e-11)

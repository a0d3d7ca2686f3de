import numpy as np
import pytest
from conftest import modular_toy, wide_frame
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.operators import features, split
from riskloom.schema import WIDE_FEATURES


def reference_cuts(times):
    """Plain restatement on a sorted list: whole ties, nearest to 70% and 85%."""
    n, ends = len(times), [i + 1 for i in range(len(times)) if i + 1 == len(times) or times[i] != times[i + 1]]

    def nearest(target, low, high):
        return min((e for e in ends if low <= e <= high), key=lambda e: (abs(e - target), e))

    first = nearest(round(n * 0.70), 1, n - 2)
    return first, nearest(round(n * 0.85), first + 1, n - 1)


CASES = [
    [r // 2 for r in range(200)],
    [r // 4 for r in range(320)],
    [0] * 50 + [1] * 38 + list(range(2, 14)),
    [0] * 10 + [1] * 60 + [2] * 20 + [3] * 10,
    [0] + [1] * 97 + [2, 3],
    list(range(7)),
]


@pytest.mark.parametrize("times", CASES)
@pytest.mark.parametrize("partitions", [1, 17])
def test_chronological_cuts(spark, times, partitions):
    df = spark.createDataFrame([(float(t),) for t in times], "t double").repartition(partitions)
    cuts = split.time_cuts(df, "t")
    first, second = reference_cuts(times)
    assert (cuts.train_rows, cuts.validation_rows, cuts.test_rows) == (first, second - first, len(times) - second)
    assert (cuts.train_last, cuts.validation_first) == (times[first - 1], times[first])
    assert (cuts.validation_last, cuts.test_first) == (times[second - 1], times[second])


@pytest.mark.parametrize("times", [[1, 1, 1, 1], [1, 1, 2, 2], [1, 2]])
def test_too_few_time_groups(spark, times):
    with pytest.raises(ValidationError, match="distinct time groups"):
        split.time_cuts(spark.createDataFrame([(float(t),) for t in times], "t double"), "t")


def test_split_is_a_range_predicate(spark):
    df = modular_toy(spark)
    out, cuts = split.chronological_split(df, "Time", "Class")
    sizes = {r.split: r.row_count for r in split.split_report(out, "Class").collect()}
    assert sizes == {"train": 280, "validation": 60, "test": 60}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.groupBy("Time").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_partition_without_a_class(spark):
    df = modular_toy(spark).withColumn("Class", F.when(F.col("Time") >= 85, 0).otherwise(F.col("Class")))
    with pytest.raises(ValidationError, match="both target classes"):
        split.chronological_split(df, "Time", "Class")


def test_order_check(spark):
    good = spark.range(2000).selectExpr("id", "CAST(floor(id / 3) AS double) AS t")
    for partitions in (1, 17):
        assert split.order_violations(good.repartition(partitions), "id", "t").first().violations == 0
    bad = good.withColumn("t", F.when(F.col("id") == 1234, 0.0).otherwise(F.col("t")))
    assert split.order_violations(bad.repartition(5), "id", "t").first().violations == 1
    with pytest.raises(ValidationError, match="non-decreasing"):
        split.require_ordered(bad, "id", "t")


def stratified(spark):
    return spark.sql("""SELECT id AS TransactionID, CAST(id % 2 AS int) AS FraudIndicator, CAST(id AS double) AS Amount,
        CAST(2 * id AS double) AS TransactionAmount, CASE WHEN id % 4 = 0 THEN 'Online' ELSE 'Retail' END AS Category,
        CAST(timestampadd(HOUR, id, TIMESTAMP'2025-01-01 00:00:00') AS string) AS Timestamp, id % 13 AS CustomerID FROM range(120)""")


def test_stratified_counts_and_seed(spark):
    df = stratified(spark)
    out = split.stratified_split(df, "TransactionID", "FraudIndicator")
    report = {r.split: (r.row_count, r.negatives, r.positives) for r in split.split_report(out, "FraudIndicator").collect()}
    assert report == {"train": (84, 42, 42), "validation": (18, 9, 9), "test": (18, 9, 9)}

    def members(frame):
        return {(r.TransactionID, r.split) for r in frame.select("TransactionID", "split").collect()}

    again = split.stratified_split(df.repartition(17), "TransactionID", "FraudIndicator")
    assert members(out) == members(again)
    assert members(out) != members(split.stratified_split(df, "TransactionID", "FraudIndicator", 7))


def test_quotas_add_up():
    for counts in ({0: 955, 1: 45}, {0: 10, 1: 11}, {0: 997, 1: 3}, {0: 7, 1: 9}):
        quotas = split.class_quotas(counts)
        n = sum(counts.values())
        holdout = int(np.ceil(n * 0.30))
        assert sum(t for t, _ in quotas.values()) == n - holdout
        assert sum(v for _, v in quotas.values()) == holdout - int(np.ceil(holdout * 0.5))


def test_related_preparation(spark):
    df = stratified(spark)
    out, state = features.prepare_related(df)
    assert state.names == ["Amount", "TransactionAmount", "TimestampHour", "TimestampDayOfWeek", "TimestampMonth",
                           "Category_Online", "Category_Retail"]
    train = features.transform_features(out, state, ["split"]).where("split = 'train'").toPandas()
    np.testing.assert_allclose(train[["Amount", "TransactionAmount", "TimestampHour"]].mean(), 0, atol=1e-9)
    np.testing.assert_allclose(train[["Amount"]].std(ddof=0), 1, atol=1e-9)
    for change, message in (
        ({"FraudIndicator": F.lit(2)}, "0/1"), ({"Timestamp": F.lit("soon")}, "unparseable"), ({"Amount": F.lit("much")}, "non-numeric"),
    ):
        with pytest.raises(ValidationError, match=message):
            features.prepare_related(df.withColumns(change))


def paired(spark):
    return wide_frame(spark, 200, lambda r: (r // 2, r, lambda i: (r * i) % 11, r % 2))


def test_wide_preparation(spark):
    df = paired(spark)
    out, state = features.prepare_wide(df)
    assert state.names == list(WIDE_FEATURES)
    assert {r.split: r.row_count for r in split.split_report(out, "Class").collect()} == {"train": 140, "validation": 30, "test": 30}
    train = out.where("split = 'train'").toPandas()
    means = {n.name: n.mean for n in state.numeric}
    np.testing.assert_allclose([means[c] for c in WIDE_FEATURES], train[list(WIDE_FEATURES)].mean().to_numpy())
    features.validate_splits(features.transform_features(out, state, ["split", "Class"]), state.names, "Class")
    with pytest.raises(ValidationError, match="infinite"):
        features.prepare_wide(df.withColumn("V3", F.when(F.col("Amount") == 5, float("inf")).otherwise(F.col("V3"))))
    ordered = df.withColumn("row", F.col("Amount").cast("long"))
    features.prepare_wide(ordered, order="row")
    with pytest.raises(ValidationError, match="non-decreasing"):
        features.prepare_wide(ordered.withColumn("row", -F.col("row")), order="row")


def test_imputation_uses_training_rows_only(spark):
    df = paired(spark).withColumn("Amount", F.when(F.col("Amount") % 10 == 3, None).otherwise(F.col("Amount")))
    out, state = features.prepare_wide(df)
    train = out.where("split = 'train'").toPandas()["Amount"]
    amount = next(n for n in state.numeric if n.name == "Amount")
    filled = train.fillna(train.median())
    np.testing.assert_allclose([amount.median, amount.mean, amount.scale], [train.median(), filled.mean(), filled.std(ddof=0)])
    changed = df.withColumn("Amount", F.when(F.col("Time") > 70, F.col("Amount") * 1000).otherwise(F.col("Amount")))
    assert features.prepare_wide(changed)[1] == state
    assert features.transform_features(out, state, ["split"]).count() == 200


def test_encoding_rules(spark):
    train = spark.createDataFrame([("b", 1.0, 7.0), ("a", 2.0, 7.0), (None, None, 7.0), ("c", 6.0, 7.0)], "c string, x double, k double")
    state = features.fit_features(train, ["x", "k"], ["c"])
    assert state.categorical[0].fill == "a" and state.names == ["x", "k", "c_a", "c_b", "c_c"]
    assert features.FeatureState.from_json(state.to_json()) == state
    new = spark.createDataFrame([("z", 3.0, 9.0), (None, None, 7.0)], "c string, x double, k double")
    rows = [tuple(r) for r in features.transform_features(new, state).collect()]
    assert rows[0][2:] == (0.0, 0.0, 0.0) and rows[1][2:] == (1.0, 0.0, 0.0) and rows[0][1] == 2.0
    empty = features.fit_features(spark.createDataFrame([(None, 1.0)], "x double, k double"), ["x", "k"])
    assert empty.dropped == ("x",) and empty.names == ["k"]

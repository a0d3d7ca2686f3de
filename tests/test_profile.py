import math

import numpy as np
import pytest
from conftest import related_tables, wide_frame

from riskloom.functions.columns import calendar_parts, check_bands, elapsed_label, risk_level
from riskloom.errors import ValidationError
from riskloom.operators import profile, relations
from riskloom.schema import WIDE_COMPONENTS
from riskloom.sinks.tables import write_profiles
from pyspark.sql import functions as F


def joined(spark):
    return relations.transaction_table(related_tables(spark))[0]


def test_related_trend_categories_and_distribution(spark):
    df = joined(spark)
    assert [(str(r.day), r.transaction_count, r.fraud_count) for r in profile.daily_trend(df, "Timestamp", "FraudIndicator").collect()] == [
        ("2022-01-01", 2, 1), ("2022-01-02", 1, 0)]
    assert [(r.category, r.fraud_rate) for r in profile.category_summary(df, "Category", "FraudIndicator").collect()] == [
        ("Food", 0.0), ("Retail", 0.0), ("Travel", 1.0)]
    bins = profile.amount_distribution(df, "Amount", "FraudIndicator").collect()
    assert [r.legitimate for r in bins] == [0, 0, 0, 1, 0, 0, 0, 0, 0, 1]
    assert [r.fraud for r in bins] == [0, 0, 0, 0, 0, 0, 1, 0, 0, 0]
    assert math.isclose(bins[0].upper, 2.9) and bins[9].upper is None


def test_trend_leaves_out_unreadable_times(spark):
    df = spark.createDataFrame([("2022-01-01 10:00:00", 1), ("never", 0)], "t string, y int")
    assert [r.transaction_count for r in profile.daily_trend(df, "t", "y").collect()] == [1]
    row = profile.table_profile(df, "y", "t").first()
    assert row.unparsed_times == 1 and row.imbalance == 1.0


def test_small_wide_profile(spark):
    data = [(0, 0, 12, 0.0), (0, 60, 30, 0.2), (1, 120, 120, 0.4)]
    df = wide_frame(spark, 3, lambda r: (data[r][1], data[r][2], lambda i: data[r][3] + (i - 1) / 100, data[r][0]))
    kpi = profile.kpi_overview(df, "Class", "Amount").first()
    assert math.isclose(kpi.fraud_rate, 1 / 3) and kpi.total_amount == 162.0
    amounts = {r.label: r for r in profile.numeric_summary_by_class(df, ["Amount"], "Class").collect()}
    assert amounts[1]["median"] == 120.0 and amounts[0].value_count == 2 and math.isclose(amounts[0].p95, 29.1)
    stats = {(r.component, r.label): r for r in profile.component_stats(df, list(WIDE_COMPONENTS), "Class").collect()}
    assert len(stats) == 56 and math.isclose(stats[("V1", 1)]["mean"], 0.4)
    assert stats[("V1", 1)].deviation is None and math.isclose(stats[("V1", 0)].deviation, np.std([0.0, 0.2], ddof=1))


def test_absent_class_is_still_listed(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0)], "y int, v double")
    rows = {r.label: r for r in profile.numeric_summary_by_class(df, ["v"], "y").collect()}
    assert rows[1].value_count == 0 and rows[1]["mean"] is None and rows[0]["mean"] == 2.0


def test_elapsed_trend(spark):
    df = spark.createDataFrame([(12.0, 0, 0.0), (40.0, 1, 7200.0), (5.0, 0, 14400.0)], "Amount double, Class int, Time double")
    rows = profile.elapsed_trend(df, "Time", "Class").collect()
    assert [(r.bucket, r.transaction_count, r.fraud_count) for r in rows] == [(0, 1, 0), (1, 1, 1), (2, 1, 0)]
    assert rows[0].label == "00–02 h"


def test_unknown_category(spark):
    df = spark.createDataFrame([(None, 1), ("a", 0)], "c string, y int")
    assert [r.category for r in profile.category_summary(df, "c", "y").collect()] == ["Unknown", "a"]
    assert [r.category for r in profile.category_summary(df, "c", "y", fill_unknown=False).collect()] == [None, "a"]


@pytest.mark.parametrize("values", [[0.0, 0.1, 0.2, 0.30000000000000004, 0.7, 1.0], [2.0, 2.0, 2.0], [-5.0, 3.0, 3.0, 100.0]])
def test_density_matches_numpy(spark, values):
    df = spark.createDataFrame([(v, 0) for v in values], "v double, y int")
    rows = profile.density_histogram(df, "v", "y", 10).collect()
    counts, edges = np.histogram(values, bins=10)
    density, _ = np.histogram(values, bins=10, density=True)
    assert [r.row_count for r in rows] == counts.tolist()
    np.testing.assert_allclose([r.density for r in rows], density)
    np.testing.assert_allclose([r.lower for r in rows], edges[:-1], atol=1e-12)


def test_calendar_and_bands(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2025-01-06 13:00:00' AS t, 30.0D AS s")
    parts = df.select(*[c.alias(n) for n, c in calendar_parts(F.col("t")).items()]).first()
    assert (parts.hour, parts.day_of_week, parts.month) == (13.0, 0.0, 1.0)
    assert df.select(risk_level("s").alias("b")).first().b == "medium"
    assert df.select(risk_level("s", 25, 65).alias("b"), elapsed_label(F.lit(5)).alias("l")).first().l == "10–12 h"
    with pytest.raises(ValidationError, match="Risk bands"):
        check_bands(70, 30)


def test_all_profiles_are_written(spark, tmp_path):
    paths = write_profiles(profile.related_profiles(joined(spark)), str(tmp_path / "related"))
    assert spark.read.parquet(paths["trend"]).count() == 2 and spark.read.parquet(paths["amount_density"]).count() == 50
    wide = wide_frame(spark, 20, lambda r: (r * 500, r, lambda i: r / i, r % 4 == 0))
    paths = write_profiles(profile.wide_profiles(wide), str(tmp_path / "wide"))
    assert spark.read.parquet(paths["components"]).count() == 56 and spark.read.parquet(paths["overview"]).first().fraud_transactions == 5
    with pytest.raises(ValidationError, match="V7"):
        profile.wide_profiles(wide.drop("V7"))

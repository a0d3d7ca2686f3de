import math

import pytest

from riskloom.errors import ValidationError
from riskloom.operators import quality


def test_duplicates_treat_missing_cells_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, float("nan")), (1, float("nan")), (2, 0.0), (2, -0.0)], "a int, b double")
    row = quality.duplicate_rows(df).first()
    assert (row.total_rows, row.distinct_rows, row.duplicate_rows) == (6, 3, 3)


def test_digest_of_long_text_gives_the_same_duplicates(spark):
    text = "x" * 5000
    df = spark.createDataFrame([(text + "a", 1), (text + "a", 1), (text + "b", 1), (None, 1), (None, 1), ("", 1)], "t string, k int")
    assert quality.duplicate_rows(df, ["t"]).first().duplicate_rows == quality.duplicate_rows(df).first().duplicate_rows == 2


def test_numeric_coercion(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("1e3",), ("abc",), ("1d",), ("Infinity",), (None,), ("",)], "v string")
    row = quality.numeric_coercion(df, ["v"]).first()
    assert (row.cells, row.non_null, row.non_numeric, row.infinite) == (8, 7, 3, 1)
    with pytest.raises(ValidationError, match="non-numeric"):
        quality.require_numeric(df, ["v"])
    with pytest.raises(ValidationError, match="infinite"):
        quality.require_numeric(df.where("v = 'Infinity'"), ["v"])


def test_target_rules(spark):
    df = spark.createDataFrame([(0,), (1,), (1,)], "y int")
    assert quality.require_target(df, "y") == {0: 1, 1: 2}
    with pytest.raises(ValidationError, match="0/1"):
        quality.require_target(spark.createDataFrame([(0,), (2,), (None,)], "y int"), "y")
    with pytest.raises(ValidationError, match="both classes"):
        quality.require_target(spark.createDataFrame([(0,)], "y int"), "y")


def test_failed_quality_checks(spark):
    df = spark.createDataFrame([("0", "10", 0), ("-1", "not-a-number", 1)], "Time string, Amount string, Class int")
    status = {r.check_name: r.status for r in quality.quality_checks(df, "Class", "Time", "Amount").collect()}
    assert status["numbers"] == "failed" and status["ranges"] == "failed"
    assert status["gaps"] == status["repeated rows"] == status["columns"] == status["labels"] == "passed"


def test_checks_of_columns_and_labels_can_fail(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (1.0, 3.0, 7)], "Time double, Amount double, Class int")
    rows = {r.check_name: (r.status, r.detail) for r in quality.quality_checks(df, "Class", "Time", "Amount", columns=["Time", "Amount", "V1", "Class"]).collect()}
    assert rows["columns"] == ("failed", "absent or undeclared: 1") and rows["labels"] == ("failed", "zero: 1, one: 0, other: 1")
    one = quality.quality_checks(df.where("Class = 0"), "Class", "Time", "Amount").where("check_name = 'labels'").first()
    assert one.status == "warning"


def test_missing_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (math.nan, None), (None, "b")], "v double, s string")
    assert {r.column_name: r.missing_cells for r in quality.missing_by_column(df).collect()} == {"v": 2, "s": 1}


def test_overview_guard(spark):
    good = spark.createDataFrame([(0, "1.0"), (1, "2")], "y int, amount string")
    quality.overview_guard(good, "y", "amount")
    for bad in ([(0, "x")], [(3, "1")], [(0, None)]):
        with pytest.raises(ValidationError, match="invalid"):
            quality.overview_guard(spark.createDataFrame(bad, "y int, amount string"), "y", "amount")

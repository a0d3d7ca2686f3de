"""Rows that earlier versions read, joined or scored wrongly."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.errors import ValidationError
from riskloom.operators import explain, payload, quality, relations, split
from riskloom.sinks import tables as sink
from riskloom.sources import csv


def test_whole_numbers_are_read_from_their_text(spark):
    cells = spark.createDataFrame([("9007199254740993",), ("1.7",), ("12.00",), ("-5",), ("1e3",), (" 7 ",), (None,)], "k string")
    got = [r[0] for r in cells.select(csv._number(T.StructField("k", T.LongType())).alias("k")).collect()]
    assert got == [9007199254740993, None, 12, -5, 1000, 7, None]


@pytest.mark.parametrize("text,valid", [
    ('{"Time":1,"Amount":2}', True), ('{"Time":1,"Amount":2}\n\t', True), ('  {"Amount":2,"Time":1}', True), ('{"Time":1,"Amount":2} junk}', False),
    ('{"Time":1,"Amount":2}}', False), ('{"Time":1,"Amount":2},{"Time":1,"Amount":2}', False), ('[{"Time":1,"Amount":2}]', False), ("", False), (None, False)])
def test_payloads_hold_one_object_and_nothing_else(spark, text, valid):
    rows = payload.parse_payloads(spark.createDataFrame([(text,)], "p string"), "p", ["Time", "Amount"]).collect()
    assert (rows[0].reject_reason is None) == valid


def test_repeated_cases_and_split_keys_are_refused(spark):
    cases = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "id string, x double")
    with pytest.raises(ValidationError, match="unique"):
        explain.shapley_values(cases, "id", ["x"], [[0.0]], lambda df: df.withColumn("score", F.col("x")[0]), max_evals=3)
    rows = spark.createDataFrame([("k", i % 2) for i in range(40)], "k string, y int")
    with pytest.raises(ValidationError, match="unique"):
        split.stratified_split(rows, "k", "y")


def test_two_keys_between_the_same_tables_keep_their_own_audit(spark):
    left = spark.createDataFrame([(1, 10), (2, 99)], "k1 int, k2 int")
    right = spark.createDataFrame([(1, 10), (2, 20)], "k1 int, k2 int")
    both = [relations.Relation("l", "r", "k2"), relations.Relation("l", "r", "k1")]
    with pytest.raises(ValidationError, match="k2"):
        relations.require_relations({"l": left, "r": right}, both)


def test_nan_is_missing_and_not_a_bad_number(spark):
    df = spark.createDataFrame([(1.0, "1"), (float("nan"), "x"), (float("inf"), None)], "a double, b string")
    rows = {r.column_name: (r.non_numeric, r.infinite) for r in quality.numeric_coercion(df, ["a", "b"]).collect()}
    assert rows == {"a": (0, 1), "b": (1, 0)}


def test_an_evaluation_keeps_its_models(spark, tmp_path):
    own = spark.createDataFrame([("m", "test", 0.5, "probability", "p >= 0.5"), ("n", "test", 0.6, "anomaly", "native")],
                                "model_name string, split string, f1 double, score_kind string, decision_rule string")
    paths = sink.write_evaluation(own, None, str(tmp_path / "own"), {})
    assert spark.read.parquet(paths["metrics"]).count() == 2
    with pytest.raises(ValidationError, match="'n'"):
        sink.write_evaluation(own.drop("score_kind", "decision_rule"), None, str(tmp_path / "given"), {"m": ("probability", "p >= 0.5")})


def test_malformed_rows_are_counted_and_not_shown(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,2\nsecret name,3,4\n")
    from riskloom.schema import Contract

    spec = Contract("t", T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())]))
    with pytest.raises(ValidationError) as caught:
        csv.read_csv(spark, str(path), spec)
    assert "1 row(s)" in str(caught.value) and "secret" not in str(caught.value)


def test_payload_text_round_trip(spark):
    text = json.dumps({"Time": 1.5, "Amount": 2})
    row = payload.parse_payloads(spark.createDataFrame([(text,)], "p string"), "p", ["Time", "Amount"]).first()
    assert (row.Time, row.Amount) == (1.5, 2.0)

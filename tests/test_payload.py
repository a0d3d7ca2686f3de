import json

import pytest
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.operators import payload
from riskloom.schema import WIDE_FEATURES

GOOD = {name: 0.0 for name in WIDE_FEATURES}


def body(**changes):
    return json.dumps({k: v for k, v in (GOOD | changes).items() if v != "drop"})


CASES = [
    (body(), None),
    (body(Amount=1e300), None),
    (body(Time=3, V1=-2), None),
    (body(V28="drop"), "missing required features: V28"),
    (body(V28="drop", Time="drop"), "missing required features: Time, V28"),
    (body(Class=1), "1 unsupported field(s)"),
    (body(artifact_dir="/tmp/x"), "1 unsupported field(s)"),
    (body(Amount="12.0"), "feature Amount must be a numeric value"),
    (body(V3=True), "feature V3 must be a numeric value"),
    (body(V3=None), "feature V3 must be a numeric value"),
    (body(V3=[1]), "feature V3 must be a numeric value"),
    (body(Amount=-1), "feature Amount cannot be negative"),
    (body(Time=-0.5, V9="x"), "feature Time cannot be negative"),
    (body().replace('"V2": 0.0', '"V2": NaN'), "payload must be a JSON object"),
    (body().replace('"V2": 0.0', '"V2": 1e400'), "feature V2 must be finite"),
    (body().replace('"V3": 0.0', '"V3": Infinity'), "payload must be a JSON object"),
    (body() + " x", "payload must be a JSON object"),
    ("[1]", "payload must be a JSON object"),
    ("", "payload must be a JSON object"),
    (None, "payload must be a JSON object"),
]


def test_json_payloads(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "i int, payload string")
    rows = payload.parse_payloads(df, "payload").orderBy("i").collect()
    assert [r.reject_reason for r in rows] == [reason for _, reason in CASES]
    assert rows[1].Amount == 1e300 and rows[3].Amount is None
    for row, (text, _) in zip(rows, CASES):
        assert "12.0" not in (row.reject_reason or "") and "/tmp" not in (row.reject_reason or "")


def test_quarantine_and_atomic_batches(spark):
    df = spark.createDataFrame([(0, body()), (1, body(Amount=-1))], "i int, payload string")
    parsed = payload.parse_payloads(df, "payload")
    accepted, rejected = payload.split_rejects(parsed)
    assert [r.i for r in accepted.collect()] == [0] and [r.i for r in rejected.collect()] == [1]
    with pytest.raises(ValidationError, match="1 transaction"):
        payload.split_rejects(parsed, atomic=True)
    with pytest.raises(ValidationError, match="at least one"):
        payload.split_rejects(parsed.where("i > 5"), atomic=True)


def test_typed_rows(spark):
    df = spark.createDataFrame([(0.0, 1.0), (-1.0, 1.0), (0.0, float("inf")), (None, 1.0)], "Time double, Amount double")
    features = ["Time", "Amount"]
    reasons = [r.w for r in df.select(payload.typed_reason(df, features).alias("w")).collect()]
    assert reasons == [None, "feature Time cannot be negative", "feature Amount must be finite", "feature Time must be a numeric value"]
    for bad, message in ((df.drop("Time"), "missing"), (df.withColumn("Class", F.lit(1)), "unsupported"),
                         (df.withColumn("Time", F.lit("1.2")), "numeric"), (df.withColumn("Time", F.lit(True)), "numeric")):
        with pytest.raises(ValidationError, match=message):
            payload.typed_reason(bad, features)


def test_case_ids(spark):
    df = spark.createDataFrame([("  case-42  ",), ("",), ("   ",), (None,), ("x" * 128,), ("x" * 129,)], "id string")
    assert [r.case_id for r in payload.case_ids(df, "id").collect()] == ["case-42", None, None, None, "x" * 128, None]
    assert payload.case_ids(spark.createDataFrame([(42,)], "id long"), "id").first().case_id == "42"
    for kind in ("boolean", "double"):
        with pytest.raises(ValidationError, match="string or integer"):
            payload.case_ids(spark.createDataFrame([(None,)], f"id {kind}"), "id")
    with pytest.raises(ValidationError, match="1 to 128"):
        payload.require_case_ids(df, "id")


def test_a_filter_leaves_the_parsing_whole(spark):
    names = ["Time", "V1"]
    df = spark.createDataFrame([('{"Time": 1, "V1": 2}',), ('{"Time": 1, "V1": true}',)], "body string")
    accepted = payload.parse_payloads(df, "body", names).where("reject_reason IS NULL")
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("variant_get") <= 2 + 2 * len(names)  # each cell is taken once, beside the look for a second value
    assert [r.V1 for r in accepted.collect()] == [2.0]


def test_columns_beside_the_payload_stay(spark):
    df = spark.createDataFrame([(7, '{"Time": 1}', "x", 5.0)], "`an.id` long, body string, reject_reason string, Time double")
    assert payload.parse_payloads(df, "body", ["Time"]).collect()[0].asDict() == {"an.id": 7, "body": '{"Time": 1}', "reject_reason": None, "Time": 1.0}

import json
import math

from conftest import SMALL, wide_frame
from pyspark.sql import functions as F

from riskloom.operators import features, models, profile, scoring
from riskloom.schema import WIDE_FEATURES
from riskloom.streaming import flows


def test_scoring_stream_equals_batch_and_resumes(spark, tmp_path):
    data = wide_frame(spark, 400, lambda r: (r // 4, r % 31, lambda i: math.cos(r / (i + 2)), r % 20 == 0))
    out, state = features.prepare_wide(data)
    scorer = scoring.ProbabilityScorer("m", models.fit_logistic(models.training_rows(out, state, "Class")), state)
    rows = [dict(r.asDict()) for r in out.select(*WIDE_FEATURES).limit(30).collect()]
    inbox = tmp_path / "in"
    inbox.mkdir()

    def deliver(name, items):
        (inbox / name).write_text("\n".join(json.dumps({"transaction_id": i, "payload": json.dumps(p)}) for i, p in items) + "\n")

    def drain():
        stream = flows.read_payload_stream(spark, str(inbox), files_per_batch=1)
        scored, rejected = flows.score_stream(stream, scorer)
        for df, name in ((scored, "scored"), (rejected, "rejected")):
            flows.write_stream(df, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination(120)

    deliver("a.json", [(f"t{i}", row) for i, row in enumerate(rows[:20])])
    drain()
    deliver("b.json", [(f"t{i + 20}", row) for i, row in enumerate(rows[20:])] + [("bad", rows[0] | {"Amount": -1.0})])
    drain()
    scored = {r.transaction_id: r.score for r in spark.read.parquet(str(tmp_path / "scored")).collect()}
    assert len(scored) == 30
    batch = scoring.score_batch(spark.createDataFrame([(f"t{i}", *[r[c] for c in WIDE_FEATURES]) for i, r in enumerate(rows)],
                                                      "transaction_id string, " + ", ".join(f"{c} double" for c in WIDE_FEATURES)),
                                scorer, ["transaction_id"])
    for r in batch.collect():
        assert math.isclose(scored[r.transaction_id], r.score, rel_tol=1e-9)
    rejected = spark.read.parquet(str(tmp_path / "rejected")).collect()
    assert [(r.transaction_id, r.reject_reason) for r in rejected] == [("bad", "feature Amount cannot be negative")]


def test_trend_and_quality_streams_match_batch_on_closed_days(spark, tmp_path):
    source = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("time", F.col("ts").cast("timestamp"))
    source.select("time", "event_type", "value").repartition(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("y", (F.col("event_type") == "error").cast("int"))
    flows.write_stream(flows.stream_trend(stream, "time", "y"), str(tmp_path / "trend"), str(tmp_path / "c1")).awaitTermination(120)
    flows.write_stream(flows.stream_quality(stream, "time", ["value", "event_type"]), str(tmp_path / "quality"), str(tmp_path / "c2")).awaitTermination(120)
    batch = {r.day: (r.transaction_count, r.fraud_count) for r in profile.daily_trend(
        source.withColumn("y", (F.col("event_type") == "error").cast("int")), "time", "y").collect()}
    got = {r.window_start.date(): (r.transaction_count, r.fraud_count) for r in spark.read.parquet(str(tmp_path / "trend")).collect()}
    assert len(got) >= len(batch) - 2 and all(batch[day] == value for day, value in got.items())
    quality = spark.read.parquet(str(tmp_path / "quality")).collect()
    assert len(quality) == len(got) and all(r.missing_cells == 0 and r.bad_numbers == r.row_count for r in quality)

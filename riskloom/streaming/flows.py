"""Streaming scoring, trends and quality counters over file sources."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom.functions.columns import is_infinite, is_missing, to_number
from riskloom.operators.payload import parse_payloads
from riskloom.operators.scoring import Scorer, score_batch


def read_payload_stream(spark: SparkSession, folder: str, id_column: str = "transaction_id", payload: str = "payload",
                        files_per_batch: int | None = None) -> DataFrame:
    """JSON-lines files holding an identifier and a transaction object as text."""
    schema = T.StructType([T.StructField(id_column, T.StringType()), T.StructField(payload, T.StringType())])
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def score_stream(payloads: DataFrame, scorer: Scorer, id_column: str = "transaction_id", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(scored, quarantined) streams; scoring keeps no state, so any trigger and restart is safe.

    Anomaly scores are ranked in the scorer's stored index: batches never read or shuffle the reference itself.
    """
    parsed = parse_payloads(payloads, payload, scorer.state.inputs)
    accepted = parsed.where(F.col("reject_reason").isNull())
    rejected = parsed.where(F.col("reject_reason").isNotNull()).select(id_column, "reject_reason")
    return score_batch(accepted, scorer, [id_column]), rejected


def write_scored(payloads: DataFrame, scorer: Scorer, folder: str, checkpoint: str, id_column: str = "transaction_id",
                 payload: str = "payload") -> StreamingQuery:
    """Scores a payload stream of any score kind batch by batch, as `score_batch` does, into folder/scored and folder/rejected.

    Each batch writes its own partition again if it is repeated, so a restart leaves no row twice. A batch is parsed once
    for both folders.
    """
    def score(batch: DataFrame, number: int) -> None:
        parsed = parse_payloads(batch, payload, scorer.state.inputs).persist(StorageLevel.DISK_ONLY)
        parts = {"scored": score_batch(parsed.where(F.col("reject_reason").isNull()), scorer, [id_column]),
                 "rejected": parsed.where(F.col("reject_reason").isNotNull()).select(id_column, "reject_reason")}
        try:
            for name, rows in parts.items():
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            parsed.unpersist()

    return payloads.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_stream(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to parquet, processing what is available and then stopping."""
    return (
        df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def stream_trend(df: DataFrame, time: str, target: str, *, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Rows and positives per closed time window; rows later than the watermark are dropped."""
    return (
        df.withWatermark(time, lateness).groupBy(F.window(time, width).alias("window"))
        .agg(F.count(F.lit(1)).alias("transaction_count"), F.sum(target).alias("fraud_count"))
        .select(F.col("window.start").alias("window_start"), "transaction_count", "fraud_count")
    )


def stream_quality(df: DataFrame, time: str, columns: list[str], *, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Rows, missing cells and bad numbers per closed time window."""
    types = dict(df.dtypes)
    missing = sum((is_missing(c, types[c]).cast("int") for c in columns), F.lit(0))
    bad = F.lit(0)
    for c in columns:
        number = to_number(c)
        failed = F.col(c).isNotNull() & ~is_missing(c, types[c]) & number.isNull()
        bad = bad + F.when(failed | is_infinite(number), 1).otherwise(0)
    return (
        df.withWatermark(time, lateness).groupBy(F.window(time, width).alias("window"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum(missing).alias("missing_cells"), F.sum(bad).alias("bad_numbers"))
        .select(F.col("window.start").alias("window_start"), "row_count", "missing_cells", "bad_numbers")
    )

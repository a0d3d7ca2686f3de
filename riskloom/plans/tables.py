"""Reads the driver tables and binds the roles (label, score) used by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A plain scan with fewer splits than cores (a small file) is dealt out before heavy per-row work.

    Tables large enough to fill the cluster already have more splits and pass through unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with label y (error events), a 0-1 score, and seconds since the first event."""
    return read(spark, folder, "events").withColumns({
        "y": (F.col("event_type") == "error").cast("int"),
        "score": F.least(F.floor(F.col("value") / 5) / 100, F.lit(1.0)),
    })


def timed_events(spark: SparkSession, folder: str) -> DataFrame:
    df = events(spark, folder)
    first = df.agg(F.min("ts")).first()[0]
    micros = F.timestamp_diff("MICROSECOND", F.lit(first).cast("timestamp_ntz"), F.col("ts"))
    return df.withColumn("seconds", micros / 1e6)


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with label y (finished orders)."""
    return read(spark, folder, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with label y (returned lines)."""
    return read(spark, folder, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


def embedding_components(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Embeddings as one column per component with a two-class label (upper half of the labels)."""
    names = [f"c{i:02d}" for i in range(64)]
    df = read(spark, folder, "embeddings").selectExpr(
        "vec_id", "CAST(label >= 5 AS INT) AS y", *[f"CAST(embedding[{i}] AS DOUBLE) AS {c}" for i, c in enumerate(names)])
    return df, names

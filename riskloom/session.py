"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "riskloom", master: str | None = None, **settings: str) -> SparkSession:
    """Session with adaptive execution, skew handling and UTC; callers override any setting.

    Shuffle partitions are only set here for local runs: on a cluster the value belongs to the
    deployment, and adaptive execution coalesces what is too fine.
    """
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            defaults["spark.sql.shuffle.partitions"] = "8"
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without it (tests) gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="riskloom-checkpoint-")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by spark.checkpoint.dir.

    Only a local session without that setting (tests) falls back to a temporary folder: on a
    cluster a machine-local folder would be lost with its machine, so the setting is required.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)

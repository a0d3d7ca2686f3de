"""Percentile ranks in a reference that is indexed once: buckets of blocks of sorted distinct scores with running counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.functions.columns import is_infinite
from riskloom.operators.ranks import boundaries, bucket_count, running_totals, with_buckets
from riskloom.session import cut_lineage

#: Distinct scores of one block, and blocks up to which the index is broadcast (about 30 MB).
BLOCK_SCORES, BROADCAST_BLOCKS = 64, 25_000


@dataclass(frozen=True)
class PercentileIndex:
    """blocks: (bucket, low, high, before, entries of (score, upto)); a block answers for scores from low to below high.

    The first block of a bucket begins at its lower cut, so every score at or above the least one of the reference
    meets exactly one block. Building it costs one pass and one shuffle of the reference; using it costs neither.
    """

    blocks: DataFrame
    cuts: tuple[float, ...]
    rows: int
    unusable: int
    block_count: int

    def percentiles(self, df: DataFrame, score: str, *, out: str = "percentile") -> DataFrame:
        """Adds the per cent of reference scores not above each row's score; null for null and NaN, 0 below the reference."""
        rows = df.withColumn("__s", F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")))
        rows = with_buckets(rows, {"__s": self.cuts}, {"__s": "__bucket"})
        blocks = self.blocks.select(F.col("bucket").alias("__b"), *[F.col(n).alias(f"__block_{n}") for n in ("low", "high", "before", "entries")])
        blocks = F.broadcast(blocks) if self.block_count <= BROADCAST_BLOCKS else blocks
        meets = (F.col("__bucket") == F.col("__b")) & (F.col("__s") >= F.col("__block_low")) & (F.col("__s") < F.col("__block_high"))
        passed = F.filter("__block_entries", lambda e: e["score"] <= F.col("__s"))
        upto = F.coalesce(F.try_element_at(passed, F.lit(-1))["upto"], F.col("__block_before"), F.lit(0))
        found = rows.join(blocks, meets, "left")
        share = F.when(F.col("__s") == float("inf"), 100.0).when(F.col("__s").isNotNull(), upto / F.lit(self.rows) * 100.0)
        return found.select(*df.columns, share.alias(out))

    def table(self) -> DataFrame:
        """(score, reference_rows) of every distinct score, for storage."""
        pieces = self.blocks.select("before", F.posexplode("entries").alias("i", "e"), "entries")
        earlier = F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("entries", F.col("i") - 1)["upto"])
        return pieces.select(F.col("e.score").alias("score"), (F.col("e.upto") - earlier).alias("reference_rows"))


def build_index(df: DataFrame, score: str, weight: Column | None = None) -> PercentileIndex:
    """Index of the scores of df, each row counted `weight` times (once by default).

    Null, NaN and infinite scores are left out and counted as unusable. Equal scores are combined before any shuffle.
    """
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    usable = F.coalesce(value.isNotNull() & ~is_infinite(value), F.lit(False))
    given = df.select(value.alias("s"), usable.alias("usable"), (F.lit(1) if weight is None else weight).cast("long").alias("w"))
    counted = cut_lineage(given.groupBy("s", "usable").agg(F.sum("w").alias("w")))  # the model behind the scores runs once
    row = counted.agg(F.sum(F.when(F.col("usable"), F.col("w"))).alias("rows"), F.sum(F.when(~F.col("usable"), F.col("w"))).alias("bad"), F.count("*").alias("n")).first()
    distinct = counted.where("usable").select("s", "w")
    cuts = boundaries(distinct, ["s"], bucket_count(df), max(1, row["n"]))["s"]
    ranked = with_buckets(running_totals(distinct, "s", {"w": F.sum("w")}), {"s": cuts}, {"s": "bucket"})
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("s")) - 1
    ranked = ranked.withColumn("part", F.floor(place / BLOCK_SCORES))
    blocks = ranked.groupBy("bucket", "part").agg(
        F.min("s").alias("least"), F.min(F.col("cum_w") - F.col("w")).alias("before"),
        F.array_sort(F.collect_list(F.struct(F.col("s").alias("score"), F.col("cum_w").alias("upto")))).alias("entries"))
    along = Window.partitionBy("bucket").orderBy("part")
    blocks = blocks.select(
        "bucket", F.when(F.col("part") == 0, float("-inf")).otherwise(F.col("least")).alias("low"),
        F.coalesce(F.lead("least").over(along), F.lit(float("inf"))).alias("high"), "before", "entries")
    blocks = cut_lineage(blocks)
    return PercentileIndex(blocks, tuple(cuts), int(row["rows"] or 0), int(row["bad"] or 0), blocks.count())

"""One-hot encoding of categories with any number of values: a fitted table of positions, joined, one sparse cell a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from riskloom.errors import ValidationError
from riskloom.session import cut_lineage


@dataclass(frozen=True)
class CategoryTable:
    """positions: (value, position) of every training value, positions from 0 in order of the values; fill: the most
    frequent one, the smallest of equals."""

    column: str
    positions: DataFrame
    fill: str
    size: int

    def encode(self, df: DataFrame, out: str) -> DataFrame:
        """Adds `out`: (size, indices, values), the sparse form of the row's one-hot vector.

        A missing category counts as `fill`; one that training never saw has no index, so all of its cells are zero. The
        table has one row per value, so a hot value on the other side can be split by adaptive execution.
        """
        value = F.coalesce(F.col(self.column).cast("string"), F.lit(self.fill))
        found = df.withColumn("__value", value).join(self.positions.select(F.col("value").alias("__value"), F.col("position").alias("__position")), "__value", "left")
        at = F.col("__position").cast("int")
        some = at.isNotNull()
        sparse = F.struct(F.lit(self.size).alias("size"), F.when(some, F.array(at)).otherwise(F.array().cast("array<int>")).alias("indices"),
                          F.when(some, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"))
        return found.select(*df.columns, sparse.alias(out))


def fit_categories(train: DataFrame, column: str) -> CategoryTable:
    """Positions of all values of a column; nothing but the fill value and the size reaches the driver.

    Values are combined before they are shuffled by range; a value's position is its place in its range, behind all values
    of the ranges before. The ranges are stored first, so positions stay the same when an executor is lost.
    """
    counts = train.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)
    top = counts.orderBy(F.desc("n"), F.asc("value")).limit(1).first()
    if top is None:
        raise ValidationError(f"{column} has no known value in training")
    placed = counts.repartitionByRange("value").sortWithinPartitions("value").select(
        "value", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("place"))
    placed = cut_lineage(placed)
    # One row for each range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    positions = placed.join(offsets, "part").select("value", (F.col("offset") + F.col("place")).alias("position"))
    return CategoryTable(column, positions, top.value, placed.count())

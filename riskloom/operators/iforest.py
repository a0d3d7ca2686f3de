"""Isolation forest: per-tree samples grown in Spark groups, scored by an Arrow function.

Each tree sees at most `sample` rows, so every group is bounded; the fitted forest is a node table
whose size depends on the settings only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.errors import ValidationError
from riskloom.operators.ranks import bottom_by_digest, key_digest
from riskloom.operators.walk import Walk

# Baseline settings and the native alert cut-off.
TREES, SAMPLE, SEED = 300, 256, 42
ALERT_ABOVE = 0.5
NODE_SCHEMA = "tree int, node int, feature int, threshold double, below int, above int, path double"


@dataclass(frozen=True)
class IsolationForest:
    """Node arrays of all trees (children are global positions; a leaf has feature -1)."""

    names: tuple[str, ...]
    sample: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    path: np.ndarray

    def score(self, features: Sequence[Column]) -> Column:
        """Anomaly score in (0, 1); larger is more anomalous."""
        shared, trees, expected = self._shared, len(self.roots), average_path(self.sample)

        def anomaly(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(np.float64) for c in columns])
            depth = shared.value._walk.total(x) / trees
            return pd.Series(2.0 ** (-depth / expected) if expected else np.ones(len(x)))

        return F.pandas_udf(anomaly, "double")(*[f.cast("double") for f in features])

    @cached_property
    def _walk(self) -> Walk:
        """The trees as rows are led down them; a worker that scores many batches keeps it."""
        return Walk(self.roots, self.feature, self.threshold, self.below, self.above, self.path, missing_above=True)

    @cached_property
    def _shared(self):
        """The arrays as a broadcast variable: their size follows from the settings."""
        return SparkContext.getOrCreate().broadcast(self)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_shared", "_walk")}

    def node_frame(self, df: DataFrame) -> DataFrame:
        """The forest as a table, for storage."""
        trees = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
        return df.sparkSession.createDataFrame(pd.DataFrame({
            "tree": trees.astype("int32"), "node": np.arange(len(self.feature), dtype="int32"),
            "feature": self.feature.astype("int32"), "threshold": self.threshold, "below": self.below.astype("int32"),
            "above": self.above.astype("int32"), "path": self.path,
        }), NODE_SCHEMA)


def average_path(n: int) -> float:
    """Expected path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grower(seed: int, depth_limit: int):
    """Function growing one tree from its sampled rows (kept free of module state for the workers)."""

    def grow(sampled: pd.DataFrame) -> pd.DataFrame:
        tree = int(sampled["tree"].iloc[0])
        x = np.stack(sampled.sort_values("place")["x"].to_numpy()).astype(np.float64)
        random = np.random.default_rng([seed, tree])
        rows = []
        pending = [(np.arange(len(x)), 0, -1, False)]
        while pending:
            members, depth, parent, is_above = pending.pop()
            node = len(rows)
            if parent >= 0:
                rows[parent][5 if is_above else 4] = node
            low, high = x[members].min(axis=0), x[members].max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= depth_limit or len(members) <= 1 or not len(usable):
                n = len(members)
                extra = 0.0 if n <= 1 else 1.0 if n == 2 else (
                    2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n)
                rows.append([tree, node, -1, 0.0, -1, -1, depth + extra])
                continue
            column = int(random.choice(usable))
            cut = float(random.uniform(low[column], high[column]))
            left = x[members, column] <= cut
            rows.append([tree, node, column, cut, -1, -1, 0.0])
            pending.append((members[~left], depth + 1, node, True))
            pending.append((members[left], depth + 1, node, False))
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "below", "above", "path"])

    return grow


def forest_from_nodes(nodes: pd.DataFrame, names: Sequence[str], sample: int) -> IsolationForest:
    """Lays the trees of a node table (children numbered within their tree) end to end."""
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
    sizes = nodes.groupby("tree", sort=True)["node"].size().to_numpy()
    roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    start = np.repeat(roots, sizes)
    inner = nodes["feature"].to_numpy() >= 0
    return IsolationForest(
        tuple(names), sample, roots, nodes["feature"].to_numpy(np.int64), nodes["threshold"].to_numpy(np.float64),
        np.where(inner, nodes["below"].to_numpy(np.int64) + start, -1),
        np.where(inner, nodes["above"].to_numpy(np.int64) + start, -1), nodes["path"].to_numpy(np.float64),
    )


def _draws(size: int, trees: int, drawn: int, seed: int) -> tuple[pd.DataFrame, int]:
    """(tree, place) of `drawn` of `size` rows for each tree, and how many distinct rows they are; places number those from 0."""
    random = np.random.default_rng(seed)
    rows = np.concatenate([random.choice(size, drawn, replace=False) for _ in range(trees)])
    distinct, place = np.unique(rows, return_inverse=True)
    return pd.DataFrame({"tree": np.repeat(np.arange(trees, dtype="int32"), drawn), "place": place.astype("int32")}), len(distinct)


def fit_isolation_forest(train: DataFrame, key: str, names: Sequence[str], *, trees: int = TREES,
                         sample: int = SAMPLE, seed: int = SEED) -> IsolationForest:
    """Grows the forest from numeric training columns; labels are not an input.

    Each tree draws its rows from the whole training part without replacement. The distinct rows drawn, at most
    trees x sample, are those of the smallest key digests: only they are ever joined or grouped.
    """
    if trees < 1 or sample < 2:
        raise ValidationError("An isolation forest needs at least one tree and two rows per tree")
    spark = train.sparkSession
    source = train.select(F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in names]).alias("x"))
    size = source.count()
    if size < 2:
        raise ValidationError("An isolation forest needs at least two training rows")
    drawn = min(sample, size)
    draws, wanted = _draws(size, trees, drawn, seed)
    pool = bottom_by_digest(source, "key", wanted, seed)
    # The pool holds at most trees x sample rows, whatever the table size, so one window may number it.
    pool = pool.withColumn("place", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(key_digest("key", seed), "key")) - 1).persist()
    try:
        picks = spark.createDataFrame(draws, "tree int, place int")
        limit = int(np.ceil(np.log2(max(drawn, 2))))
        nodes = (
            pool.select("place", "x").join(F.broadcast(picks), "place")
            .groupBy("tree").applyInPandas(_grower(seed, limit), NODE_SCHEMA)
        ).toPandas()  # at most trees x (2 x sample - 1) rows
    finally:
        pool.unpersist()
    return forest_from_nodes(nodes, names, drawn)

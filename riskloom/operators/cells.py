"""Whole training parts, counted by the cells of a grid of cuts.

A binned tree knows a row only by its codes, the numbers of cuts below its values. So rows of equal codes and label are one
row with copies to it, and are counted in Spark: no row is left out, and what is gathered follows from the distinct codes.
The cuts come from all rows too: all middles between few values, else those at even ranks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.operators.ranks import MAX_BUCKETS, bucket_count, locate_ranks

#: Features whose codes share one whole number.
_PACKED = 8


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The rows of a batch whose first column holds arrays of one length."""
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _few_values(rows: DataFrame, most: int) -> dict[int, np.ndarray]:
    """The distinct values, in order, of each feature that has at most `most`."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for j, values in enumerate(_matrix(batch).T):
                    known = found.get(j, values[:1])
                    if len(known) <= most:  # one more than that shows that there are too many
                        new = values[known.take(np.searchsorted(known, values), mode="clip") != values]
                        found[j] = np.unique(np.concatenate([known, new]))[: most + 1] if len(new) else known
        for j, values in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), j, np.int32)), pa.array(values)], ["feature", "value"])

    distinct = rows.select("x").mapInArrow(seen, "feature int, value double").groupBy("feature").agg(F.slice(F.sort_array(F.collect_set("value")), 1, most + 1).alias("v"))
    return {r.feature: np.array(r.v) for r in distinct.collect() if len(r.v) <= most}


def _next_below(rows: DataFrame, values: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each of some ascending values of a feature, the greatest smaller one that a row has; -inf where there is none."""

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = {j: np.full(len(v) + 1, -np.inf) for j, v in values.items()}
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                for j, v in values.items():
                    np.maximum.at(top[j], np.searchsorted(v, x[:, j], side="right"), x[:, j])
        for j, found in top.items():
            place = np.flatnonzero(found > -np.inf).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), j, np.int32)), pa.array(place), pa.array(found[place])], ["feature", "place", "value"])

    best = {j: np.full(len(v) + 1, -np.inf) for j, v in values.items()}
    tops = rows.select("x").mapInArrow(greatest, "feature int, place int, value double").groupBy("feature", "place").agg(F.max("value").alias("value"))
    for r in tops.collect():
        best[r.feature][r.place] = r.value
    return {j: np.maximum.accumulate(v)[:-1] for j, v in best.items()}


def _middles(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    middle = (low + high) / 2
    return np.where(middle < high, middle, low)  # neighbouring doubles


def grid_cuts(rows: DataFrame, features: int, total: int, bins: int) -> list[np.ndarray]:
    """The cuts of `trees.even_cuts` for each feature of all `total` rows(x array<double>), none of which is gathered."""
    few = _few_values(rows, bins)
    many = [j for j in range(features) if j not in few]
    cuts = {j: _middles(v[:-1], v[1:]) for j, v in few.items()}
    if many:
        wide = rows.select(*[F.col("x")[j].alias(f"c{j}") for j in many])
        ranks = F.expr(f"transform(sequence(1, {bins - 1}), i -> named_struct('rank_label', CAST(i AS STRING), 'rank', CAST(total * i div {bins} + 1 AS BIGINT)))")
        buckets = max(bucket_count(wide, len(many)), min(MAX_BUCKETS, 8 * bins, 65_536 // len(many)))
        found = locate_ranks(wide, [f"c{j}" for j in many], ranks, buckets=buckets, rows=total, most=bins).select("column_name", "value").distinct().toPandas()
        at = {j: np.sort(found["value"][found["column_name"] == f"c{j}"].to_numpy()) for j in many}
        for j, below in _next_below(rows, at).items():
            inside = np.isfinite(below)
            cuts[j] = _middles(below[inside], at[j][inside])
    return [cuts[j] for j in range(features)]


def key_columns(features: Sequence[Column], cuts: Sequence[np.ndarray]) -> list[Column]:
    """Whole numbers that hold the codes of eight features each, the first highest; a missing value has code 0."""

    def packed(cuts: Sequence[np.ndarray]):
        def key(*columns: pd.Series) -> pd.Series:
            out = np.zeros(len(columns[0]), np.uint64)
            for column, c in zip(columns, cuts, strict=True):
                x = column.to_numpy(np.float64)
                out = out << 8 | np.where(np.isnan(x), 0, np.searchsorted(c, x, side="left")).astype(np.uint64)
            return pd.Series(out.view(np.int64))

        return F.pandas_udf(key, "long")

    return [packed(cuts[i : i + _PACKED])(*[f.cast("double") for f in features[i : i + _PACKED]]) for i in range(0, len(cuts), _PACKED)]


def key_codes(keys: Sequence[np.ndarray], features: int) -> np.ndarray:
    """The codes, row by row, that some keys hold."""
    codes = [k.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, _PACKED)[:, _PACKED - min(_PACKED, features - _PACKED * i) :] for i, k in enumerate(keys)]
    return np.ascontiguousarray(np.concatenate(codes, axis=1))


def count_cells(rows: DataFrame, cuts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, label, copies) of all rows(x array<double>, label int), one for each distinct pair of codes and label, in their order."""
    keys = key_columns([F.col("x")[j] for j in range(len(cuts))], cuts)
    names = [f"key{i}" for i in range(len(keys))]
    counted = rows.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], "label").groupBy(*names, "label").agg(F.count("*").alias("copies")).toArrow()
    columns = {n: counted[n].to_numpy() for n in [*names, "label", "copies"]}
    order = np.lexsort([columns["label"], *[columns[n].view(np.uint64) for n in reversed(names)]])
    return key_codes([columns[n][order] for n in names], len(cuts)), columns["label"][order].astype(np.int64), columns["copies"][order]

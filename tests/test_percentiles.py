"""The stored percentile index against searches in a sorted list, in batch, in a stream and by its plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import percentiles, scoring


def values(spark, numbers):
    return spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "id int, raw_score double")


@pytest.mark.parametrize("block,broadcast", [(3, 25_000), (64, 0)])
def test_ranks_with_ties_nulls_and_values_outside(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(percentiles, "BLOCK_SCORES", block)
    monkeypatch.setattr(percentiles, "BROADCAST_BLOCKS", broadcast)
    random = np.random.default_rng(3)
    known = np.concatenate([np.round(random.normal(size=900), 2), np.full(400, 0.25), [-7.0, 9.0]])
    index = percentiles.build_index(values(spark, [*map(float, known), None, float("nan"), float("inf")]), "raw_score")
    assert (index.rows, index.unusable) == (1302, 3)
    asked = [-100.0, -7.0, 9.0, 100.0, 0.25, 0.2500001, float("inf"), float("-inf"), *map(float, random.normal(size=300)), *map(float, known[:50])]
    got = index.percentiles(values(spark, [*asked, None, float("nan")]), "raw_score").orderBy("id").collect()
    ordered = np.sort(known)
    np.testing.assert_array_equal([r.percentile for r in got[:-2]], np.searchsorted(ordered, asked, side="right") / 1302 * 100)
    assert got[-1].percentile is None and got[-2].percentile is None
    direct = scoring.anomaly_percentile(values(spark, asked), values(spark, map(float, known)), "raw_score").orderBy("id").collect()
    assert [r.percentile for r in direct] == [r.percentile for r in got[:-2]]


def test_table_rebuilds_the_index(spark):
    index = percentiles.build_index(values(spark, [1.0, 1.0, 2.0, 5.0, 5.0, 5.0, None]), "raw_score")
    assert sorted(tuple(r) for r in index.table().collect()) == [(1.0, 2), (2.0, 1), (5.0, 3)]
    again = percentiles.build_index(index.table(), "score", F.col("reference_rows"))
    assert again.rows == 6 and again.unusable == 0
    assert sorted(tuple(r) for r in again.table().collect()) == sorted(tuple(r) for r in index.table().collect())


def test_empty_reference_and_one_value(spark):
    assert percentiles.build_index(values(spark, [None]), "raw_score").rows == 0
    index = percentiles.build_index(values(spark, [4.0]), "raw_score")
    got = index.percentiles(values(spark, [3.9, 4.0, 4.1]), "raw_score").orderBy("id").collect()
    assert [r.percentile for r in got] == [0.0, 100.0, 100.0]


def test_a_stream_ranks_without_shuffling(spark, tmp_path):
    index = percentiles.build_index(values(spark, [float(i % 50) for i in range(500)]), "raw_score")
    values(spark, [1.0, 49.0, -3.0]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, raw_score double").parquet(str(tmp_path / "in"))
    query = index.percentiles(stream, "raw_score").writeStream.format("memory").queryName("ranked").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("ranked").collect()) == [(0, 1.0, 4.0), (1, 49.0, 100.0), (2, -3.0, 0.0)]
    plan = index.percentiles(values(spark, [1.0]), "raw_score")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan

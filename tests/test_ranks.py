import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ranks

VALUES = [3.0] * 40 + [1.0, 2.0, 2.0, 5.5, -4.0, 9.25, 7.0, 0.0, 100.0] + [float(i % 13) for i in range(70)]


def frame(spark, partitions=1):
    rows = [("ab"[i % 3 == 0], v, i % 2) for i, v in enumerate(VALUES)]
    rows += [("a", None, 1), ("b", float("nan"), 0)]
    return spark.createDataFrame(rows, "k string, v double, y int").repartition(partitions)


@pytest.mark.parametrize("partitions, buckets", [(1, 2), (4, 16), (17, 64)])
def test_quantiles_match_numpy_under_any_partitioning(spark, partitions, buckets):
    got = {r.k: r for r in ranks.exact_quantiles(frame(spark, partitions), ["v"], {"q10": 0.1, "q50": 0.5, "q95": 0.95}, ["k"], buckets).collect()}
    for k in "ab":
        values = [v for i, v in enumerate(VALUES) if "ab"[i % 3 == 0] == k]
        assert got[k].total == len(values)
        np.testing.assert_allclose([got[k].q10, got[k].q50, got[k].q95], np.quantile(values, [0.1, 0.5, 0.95]), rtol=1e-12)


def test_quantile_of_constant_and_single(spark):
    df = spark.createDataFrame([(5.0,)] * 10, "v double")
    assert ranks.exact_quantiles(df, ["v"], {"m": 0.5}).first().m == 5.0
    assert ranks.exact_quantiles(df.limit(1), ["v"], {"m": 0.95}).first().m == 5.0
    assert ranks.exact_quantiles(spark.createDataFrame([(None,)], "v double"), ["v"], {"m": 0.5}).first() is None


def test_several_columns_and_infinities(spark):
    df = spark.createDataFrame([(1.0, 10), (2.0, 20), (math.inf, 30)], "a double, b int")
    got = {r.column_name: r.m for r in ranks.exact_quantiles(df, ["a", "b"], {"m": 0.5}).collect()}
    assert got == {"a": 2.0, "b": 20.0}


def test_located_ranks_report_their_tie_group(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (2.0,), (5.0,)], "v double")
    row = ranks.locate_ranks(df, ["v"], {"third": F.lit(3)}, buckets=4).first()
    assert (row.value, row.n_below, row.n_upto, row.total) == (2.0, 1, 4, 5)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("partitions, buckets", [(1, 2), (17, 64)])
def test_running_totals_match_pandas(spark, descending, partitions, buckets):
    df = frame(spark, partitions).where("v IS NOT NULL AND NOT isnan(v)")
    got = ranks.running_totals(df, "v", {"n": F.count(F.lit(1)), "s": F.sum("y")}, ["k"], descending=descending, following=True,
                               buckets=buckets).toPandas()
    base = df.toPandas().groupby(["k", "v"]).y.agg(n="size", s="sum").reset_index().sort_values(["k", "v"], ascending=[True, not descending])
    base["cum_n"], base["cum_s"] = base.groupby("k").n.cumsum(), base.groupby("k").s.cumsum()
    base["next_n"] = base.groupby("k").n.shift(-1)
    both = base.merge(got, on=["k", "v"], suffixes=("", "_got"))
    assert len(both) == len(base) == len(got)
    assert (both.cum_n == both.cum_n_got).all() and (both.cum_s == both.cum_s_got).all()
    pd.testing.assert_series_equal(both.next_n.fillna(-1), both.next_n_got.fillna(-1), check_names=False, check_dtype=False)


def test_digest_sample_is_seeded_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    picks = [sorted(r.k for r in ranks.bottom_by_digest(df.repartition(p), "k", 100, 42).collect()) for p in (1, 4, 17)]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 100
    whole = sorted(r.k for r in df.orderBy(ranks.key_digest("k", 42), "k").limit(100).collect())
    assert picks[0] == whole
    assert picks[0] != sorted(r.k for r in ranks.bottom_by_digest(df, "k", 100, 7).collect())
    assert ranks.bottom_by_digest(df.limit(3), "k", 100, 42).count() == 3


def test_no_row_level_window_runs_in_one_task(spark):
    df = spark.range(100_000).selectExpr("rand(3) AS v", "CAST(id % 2 AS int) AS y")
    plan = ranks.running_totals(df, "v", {"pos": F.sum("y")}, descending=True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    for block in text.split("Window")[1:]:
        if "bucket" in block.split("\n")[0] and "v#" in block.split("\n")[0]:
            assert "SinglePartition" not in block.split("Exchange")[1].split("\n")[0]
    assert "CartesianProduct" not in text

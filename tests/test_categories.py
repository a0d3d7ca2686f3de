import random

import pytest

from riskloom.errors import ValidationError
from riskloom.operators import categories


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, c string")


def test_positions_follow_the_order_of_values_at_any_size(spark):
    rng = random.Random(3)
    values = [f"{rng.choice('äzbA')}{rng.randint(0, 10**9)}" for _ in range(100_000)]
    table = categories.fit_categories(frame(spark, values + values[:500]).repartition(7), "c")
    distinct = sorted(set(values), key=lambda v: v.encode())
    got = table.encode(frame(spark, [values[0], values[77], "never seen", None]), "hot").orderBy("id").collect()
    assert table.size == len(distinct) and table.fill == min(values[:500])
    assert [(r.hot.indices, r.hot.values) for r in got] == [([distinct.index(v)], [1.0]) if v else ([], []) for v in (values[0], values[77], None, table.fill)]
    assert {r.hot.size for r in got} == {len(distinct)}
    assert table.positions.selectExpr("count(DISTINCT position)", "min(position)", "max(position)").first() == (len(distinct), 0, len(distinct) - 1)


def test_hot_values_missing_ones_and_empty_columns(spark):
    table = categories.fit_categories(frame(spark, ["b"] * 500 + ["a", None, "c", "a"]), "c")
    rows = table.encode(frame(spark, ["c", None, "b", "d"]).withColumnRenamed("id", "value").withColumnRenamed("value", "id"), "hot").orderBy("id").collect()
    assert [r.hot.indices for r in rows] == [[2], [1], [1], []] and table.fill == "b"
    with pytest.raises(ValidationError, match="no known value"):
        categories.fit_categories(frame(spark, [None, None]), "c")

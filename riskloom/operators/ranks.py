"""Order statistics and running totals that never sort a table in one task.

Every operator here cuts the value axis at literal boundaries first. The boundaries come from one
small aggregate; they only decide how evenly work is spread, never the result, so they may come
from a sample. Because they are literals, a lost executor recomputes the same buckets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_BUCKETS = 8192
ROWS_PER_BOUNDARY = 400
# Tables derived from (group, bucket) pairs are broadcast only up to this many rows.
BROADCAST_ROWS = 200_000


def bucket_count(df: DataFrame, columns: int = 1) -> int:
    """Buckets follow the shuffle partitioning the session was sized with, fewer for many columns."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(32, min(MAX_BUCKETS, 4 * partitions, 65_536 // columns))


def boundaries(df: DataFrame, columns: Sequence[str], buckets: int, rows: int) -> dict[str, list[float]]:
    """Ascending inner cut points per column, at most buckets - 1 of them."""
    wanted = ROWS_PER_BOUNDARY * buckets
    source = df.select(*columns)
    if rows > 4 * wanted:
        source = source.sample(wanted / rows, seed=7)
    # One SQL text per column: building thousands of literals one by one takes longer than the scan.
    shares = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    row = source.selectExpr(*[
        f"percentile_approx(nanvl(CAST(`{c}` AS DOUBLE), NULL), array({shares}), {max(1000, 2 * buckets)}) AS `{c}`"
        for c in columns
    ]).first()
    return {c: sorted({v for v in (row[c] or []) if math.isfinite(v)}) for c in columns}


def with_buckets(df: DataFrame, cuts: Mapping[str, Sequence[float]], names: Mapping[str, str]) -> DataFrame:
    """Adds an integer bucket per column; equal values always share a bucket."""
    columns = list(cuts)
    out = df
    usable = [c for c in columns if cuts[c]]
    if usable:
        doubles = {c: f"__double_{i}" for i, c in enumerate(usable)}
        out = out.selectExpr("*", *[f"CAST(`{c}` AS DOUBLE) AS `{doubles[c]}`" for c in usable])
        out = Bucketizer(
            inputCols=[doubles[c] for c in usable],
            outputCols=[names[c] for c in usable],
            splitsArray=[[-math.inf, *cuts[c], math.inf] for c in usable],
            handleInvalid="keep",
        ).transform(out)
    buckets = [f"CAST(`{names[c]}` AS INT) AS `{names[c]}`" if c in usable else f"0 AS `{names[c]}`" for c in columns]
    return out.selectExpr(*[f"`{c}`" for c in df.columns], *buckets)


def _size_up(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows, about how many key groups) in one aggregate."""
    if not keys:
        return df.count(), 1
    row = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*keys))).first()
    return row[0], max(1, row[1])


def _hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def locate_ranks(
    df: DataFrame,
    columns: Sequence[str],
    ranks: Mapping[str, Column] | Column,
    keys: Sequence[str] = (),
    buckets: int | None = None,
    rows: int | None = None,
    most: int = BROADCAST_ROWS,
) -> DataFrame:
    """Values found at given 1-based ranks of each column, per key group.

    `ranks` maps a label to an integer expression over `total`, the number of non-missing values of
    the group; many ranks can be one array of structs (rank_label, rank) instead, of at most `most`. Result: keys, column_name, total, rank_label, rank, value, n_below, n_upto, where
    n_below counts values strictly smaller and n_upto values not greater.

    Two narrow passes instead of a sort: a histogram over (keys, column, bucket) tells which bucket
    holds each rank, then only those buckets are counted by value. Hot values and hot groups
    collapse in the map-side combine of both passes.
    """
    keys = list(keys)
    rows, groups = (rows, 1) if rows and not keys else _size_up(df, keys)
    buckets = buckets or bucket_count(df, len(columns))
    cuts = boundaries(df, columns, buckets, rows)
    names = {c: f"__bucket_{i}" for i, c in enumerate(columns)}
    # Columns travel by number; their names come back on the few result rows. One SQL text keeps
    # planning quick for wide tables.
    cells = F.expr("explode(array(" + ", ".join(
        f"named_struct('column_no', {i}, 'value', CAST(`{c}` AS DOUBLE), 'bucket', `{names[c]}`)" for i, c in enumerate(columns)
    ) + "))").alias("cell")
    long = (
        with_buckets(df.select(*keys, *columns), cuts, names)
        .select(*keys, cells).select(*keys, "cell.*")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )
    group = [*keys, "column_no"]
    by_bucket = Window.partitionBy(*group).orderBy("bucket")
    histogram = (
        long.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    )
    single = isinstance(ranks, Column)
    wanted = F.explode(ranks if single else F.array(*[
        F.struct(F.lit(label).alias("rank_label"), rank.cast("long").alias("rank")) for label, rank in ranks.items()
    ])).alias("target")
    targets = (
        histogram.select(*group, "bucket", "before", "n", "total", wanted)
        .select(*group, "bucket", "before", "n", "total", "target.*")
        .where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n")))
        .drop("n")
    )
    bound = groups * len(columns) * (most if single else len(ranks))
    chosen = targets.select(*group, "bucket", "before").distinct()
    in_bucket = Window.partitionBy(*group, "bucket").orderBy("value")
    counted = (
        long.join(_hint(chosen, bound), [*group, "bucket"])
        .groupBy(*group, "bucket", "before", "value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n_upto", F.col("before") + F.sum("n").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n_below", F.col("n_upto") - F.col("n"))
        .drop("n", "before")
    )
    return (
        counted.join(_hint(targets.drop("before"), bound), [*group, "bucket"])
        .where((F.col("rank") > F.col("n_below")) & (F.col("rank") <= F.col("n_upto")))
        .select(*keys, F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column_no") + 1).alias("column_name"),
                "total", "rank_label", "rank", "value", "n_below", "n_upto")
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Mapping[str, float],
    keys: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per key group: keys, column_name, total, one column per share."""
    total = F.col("total")
    position = {name: (total - 1) * F.lit(float(q)) for name, q in shares.items()}
    ranks: dict[str, Column] = {}
    for name, place in position.items():
        ranks[f"{name}|lo"] = F.floor(place) + 1
        ranks[f"{name}|hi"] = F.ceil(place) + 1
    found = locate_ranks(df, columns, ranks, keys, buckets)
    picks = []
    for name, place in position.items():
        low = F.max(F.when(F.col("rank_label") == f"{name}|lo", F.col("value")))
        high = F.max(F.when(F.col("rank_label") == f"{name}|hi", F.col("value")))
        weight = F.max(place - F.floor(place))
        picks.append(F.when(low == high, low).otherwise(low + (high - low) * weight).alias(name))
    return found.groupBy(*keys, "column_name", "total").agg(*picks)


def running_totals(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    keys: Sequence[str] = (),
    *,
    descending: bool = False,
    following: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sums over the distinct values of `order`, per key group.

    Values of `order` must not be null: a null one gets no running sum. No filter is added here,
    because filtering on a computed score makes the optimizer repeat that computation.
    Rows are first combined to one per (keys, value). Adds cum_<name> for each sum, and with
    `following` also next_<name>, the same sum at the next distinct value (null at the end).
    """
    keys = list(keys)
    rows, groups = _size_up(df, keys)
    buckets = buckets or bucket_count(df)
    cuts = boundaries(df, [order], buckets, rows)
    distinct = df.groupBy(*keys, order).agg(*[expression.alias(name) for name, expression in sums.items()])
    bucketed = with_buckets(distinct, cuts, {order: "bucket"})
    part = [*keys, "bucket"]
    along = F.col("bucket").desc() if descending else F.col("bucket").asc()
    edge = F.max_by if descending else F.min_by
    edges = bucketed.groupBy(*part).agg(
        *[F.sum(name).alias(f"sum_{name}") for name in sums],
        edge(F.struct(*sums), F.col(order)).alias("opening"),
    )
    if not keys:
        # One row per bucket, so a single window over all of them is at most `buckets` rows.
        edges = edges.withColumn("__all", F.lit(1))
    across = Window.partitionBy(*(keys or ["__all"])).orderBy(along)
    offsets = edges.select(
        *part,
        *[(F.sum(f"sum_{name}").over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"sum_{name}"))
          .alias(f"before_{name}") for name in sums],
        F.lead("opening").over(across).alias("next_opening"),
    )
    inside = Window.partitionBy(*part).orderBy(F.col(order).desc() if descending else F.col(order).asc())
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    within = bucketed.select(
        "*",
        *[F.sum(name).over(running).alias(f"in_{name}") for name in sums],
        *([F.lead(F.struct(*sums)).over(inside).alias("next_inside")] if following else []),
    )
    # A left join adds no null filters, so both uses of the combined rows share one exchange.
    joined = within.join(_hint(offsets, groups * buckets), part, "left")
    columns = [*keys, order, *sums, *[(F.col(f"in_{s}") + F.col(f"before_{s}")).alias(f"cum_{s}") for s in sums]]
    if following:
        after = F.coalesce("next_inside", "next_opening")
        columns += [after.getField(name).alias(f"next_{name}") for name in sums]
    return joined.select(*columns)


def key_digest(key: str | Column, seed: int) -> Column:
    """Seeded pseudo-random order of rows: md5 of 'key-seed'."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))


def bottom_by_digest(df: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """The `limit` rows with the smallest key digest: a seeded sample without replacement.

    A prefix test on the digest keeps about twice the wanted rows before the top-k, so the merge
    stays small however many partitions the table has. It widens until enough rows pass.
    """
    marked = df.withColumn("__digest", key_digest(key, seed))
    rows = df.count()
    share = 1.0 if rows <= 4 * limit else min(1.0, (2 * limit + 64) / rows)
    while share < 1.0:
        ceiling = format(int(share * 16**8), "08x")
        candidates = marked.where(F.col("__digest") < ceiling)
        if candidates.count() >= limit:
            marked = candidates
            break
        share = min(1.0, share * 2)
    return marked.orderBy("__digest", key).limit(limit).drop("__digest")

"""Leakage-safe train/validation/test splits and the order check they rest on.

Both splits find their cut points first and then mark rows with a plain comparison, so the table
itself is never sorted or shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from riskloom.errors import ValidationError
from riskloom.operators.quality import require_target
from riskloom.operators.ranks import boundaries, bucket_count, key_digest, locate_ranks, with_buckets

# Partition names and their shares.
SPLITS = ("train", "validation", "test")
TRAIN_SHARE, UP_TO_VALIDATION_SHARE = 0.70, 0.85
# Digest prefix length: 65,536 even buckets.
DIGEST_PREFIX = 4


@dataclass(frozen=True)
class TimeCuts:
    """Chronological boundaries in the time column's own unit."""

    train_last: float
    validation_first: float
    validation_last: float
    test_first: float
    train_rows: int
    validation_rows: int
    test_rows: int


def order_violations(df: DataFrame, order: str, time: str) -> DataFrame:
    """One row: rows, and rows whose time is smaller than the row before them in source order.

    Rows are compared inside buckets of the order column, then only the bucket edges are compared
    across buckets.
    """
    rows = df.count()
    buckets = bucket_count(df)
    cuts = boundaries(df, [order], buckets, rows)
    bucketed = with_buckets(df.select(F.col(order).alias("ord"), F.col(time).alias("t")), {"ord": cuts[order]}, {"ord": "bucket"})
    inside = Window.partitionBy("bucket").orderBy("ord", "t")
    steps = bucketed.withColumn("previous", F.lag("t").over(inside))
    per_bucket = steps.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") < F.col("previous")).alias("inside"),
        F.min_by("t", F.struct("ord", "t")).alias("first_t"), F.max_by("t", F.struct("ord", "t")).alias("last_t"),
    )
    # One row per bucket: this window sees at most `buckets` rows.
    across = Window.partitionBy(F.lit(1)).orderBy("bucket")
    return per_bucket.withColumn("before_t", F.lag("last_t").over(across)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("inside") + F.coalesce((F.col("first_t") < F.col("before_t")).cast("int"), F.lit(0))), F.lit(0))
        .alias("violations"),
    )


def require_ordered(df: DataFrame, order: str, time: str) -> None:
    if order_violations(df, order, time).first().violations:
        raise ValidationError(f"{time} must be non-decreasing in the order of {order}; input was not reordered")


def _nearest(below: int, upto: int, target: int, lower: int, upper: int) -> int | None:
    """Nearest allowed end of the tie group holding the target row; the lower end wins a tie."""
    ends = [end for end in (below, upto) if lower <= end <= upper]
    return min(ends, key=lambda end: (abs(end - target), end)) if ends else None


def time_cuts(df: DataFrame, time: str, target: str | None = None) -> TimeCuts:
    """Whole-tie boundaries nearest to 70% and 85% of the rows."""
    clean = df.select(F.col(time).cast("double").alias("t"), *([F.col(target).alias("y")] if target else []))
    row = clean.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t").isNull() | F.isnan("t")).alias("bad")).first()
    if row.bad:
        raise ValidationError(f"{time} contains missing values and cannot define chronological splits")
    n = row.n
    failure = ValidationError("Not enough distinct time groups for three chronological partitions")
    if n < 3:
        raise failure
    first_target, second_target = round(n * TRAIN_SHARE), round(n * UP_TO_VALIDATION_SHARE)

    def tie_groups(*wanted: int) -> dict[int, tuple[float, int, int]]:
        found = locate_ranks(clean, ["t"], {str(r): F.lit(r) for r in set(wanted)}, rows=n).collect()
        return {r.rank: (r.value, r.n_below, r.n_upto) for r in found}

    aim = min(max(first_target, 1), n - 2)
    groups = tie_groups(aim, second_target)
    first_value, below, upto = groups[aim]
    first = _nearest(below, upto, first_target, 1, n - 2)
    if first is None:
        raise failure
    first_ends_group = first == upto
    aim = min(max(second_target, first + 1), n - 1)
    if aim not in groups:
        groups |= tie_groups(aim)
    second_value, below, upto = groups[aim]
    second = _nearest(below, upto, second_target, first + 1, n - 1)
    if second is None:
        raise failure
    # A cut lies just after or just before its tie group; the time on its other side is one min or max away.
    edges = clean.agg(*[
        e for i, v in enumerate((first_value, second_value)) for e in (
            F.max(F.when(F.col("t") < v, F.col("t"))).alias(f"before{i}"), F.min(F.when(F.col("t") > v, F.col("t"))).alias(f"after{i}"))
    ]).first()
    first_pair = (first_value, edges.after0) if first_ends_group else (edges.before0, first_value)
    second_pair = (second_value, edges.after1) if second == upto else (edges.before1, second_value)
    return TimeCuts(*first_pair, *second_pair, first, second - first, n - second)


def chronological_split(df: DataFrame, time: str, target: str | None = None) -> tuple[DataFrame, TimeCuts]:
    """Adds `split`; rows with equal times stay together, and each part must hold both classes."""
    if target:
        require_target(df, target)
    cuts = time_cuts(df, time, target)
    t = F.col(time).cast("double")
    split = F.when(t <= cuts.train_last, "train").when(t <= cuts.validation_last, "validation").otherwise("test")
    out = df.withColumn("split", split)
    if target:
        for r in out.groupBy("split").agg(F.count_if(F.col(target) == 0).alias("neg"),
                                          F.count_if(F.col(target) == 1).alias("pos")).collect():
            if not (r.neg and r.pos):
                raise ValidationError(f"Chronological {r.split} partition must contain both target classes")
    return out, cuts


def class_quotas(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Per class, how many rows go to train and to validation (largest remainders, lower label first)."""
    def share_out(sizes: dict[int, int], places: int) -> dict[int, int]:
        total = sum(sizes.values())
        exact = {k: v * places / total for k, v in sizes.items()}
        given = {k: int(e) for k, e in exact.items()}
        for k in sorted(sizes, key=lambda k: (given[k] - exact[k], k))[:places - sum(given.values())]:
            given[k] += 1
        return given

    n = sum(counts.values())
    holdout = math.ceil(n * 0.30)
    train = share_out(counts, n - holdout)
    rest = {k: counts[k] - train[k] for k in counts}
    test_total = -(-holdout // 2)
    validation = share_out(rest, holdout - test_total)
    return {k: (train[k], validation[k]) for k in counts}


def _digest_cuts(df: DataFrame, label: str, digest: str, ranks: dict[int, tuple[int, ...]]) -> dict[tuple[int, int], str]:
    """Digest of the row at each wanted rank of each class.

    A histogram over digest prefixes names the bucket of each rank; only those buckets are ranked
    row by row. Digests are uniform, so a bucket holds about 1/65,536 of its class.
    """
    prefix = F.substring(digest, 1, DIGEST_PREFIX)
    histogram = df.groupBy(label, prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy(label).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    placed = histogram.withColumn("upto", F.sum("n").over(running)).withColumn("before", F.col("upto") - F.col("n"))
    hit = F.lit(False)
    for k, wanted in ranks.items():
        for r in wanted:
            hit = hit | ((F.col(label) == k) & (F.col("before") < r) & (F.col("upto") >= r))
    chosen = {(r[label], r.prefix): r.before for r in placed.where(hit).collect()}
    inside = Window.partitionBy(label, "prefix").orderBy(digest)
    pick = F.lit(False)
    for (k, p) in chosen:
        pick = pick | ((F.col(label) == k) & (prefix == p))
    ranked = df.where(pick).select(label, prefix.alias("prefix"), digest).withColumn("place", F.row_number().over(inside))
    wanted_rows = F.lit(False)
    for (k, p), before in chosen.items():
        local = [r - before for r in ranks[k] if r > before]
        wanted_rows = wanted_rows | ((F.col(label) == k) & (F.col("prefix") == p) & F.col("place").isin(*(local or [-1])))
    return {(r[label], chosen[(r[label], r.prefix)] + r.place): r[digest] for r in ranked.where(wanted_rows).collect()}


def stratified_split(df: DataFrame, key: str, target: str, seed: int = 42) -> DataFrame:
    """Adds `split`: seeded 70/15/15 within each class, ordered by the digest of a unique key.

    Rows that share a key could not be told apart by the cuts, so repeated and missing keys are refused.
    """
    counts = require_target(df, target)
    if df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).count():
        raise ValidationError(f"Split key {key} must be present and unique")
    quotas = class_quotas(counts)
    if min(counts.values()) < 2 or any(not (t and v and counts[k] - t - v) for k, (t, v) in quotas.items()):
        raise ValidationError("Not enough examples of each class for stratified 70/15/15 splits")
    marked = df.withColumn("__digest", key_digest(key, seed))
    ranks = {k: (t, t + v) for k, (t, v) in quotas.items()}
    cuts = _digest_cuts(marked.select(target, "__digest"), target, "__digest", ranks)
    split = None
    for k, (t, v) in quotas.items():
        for last, name in ((t, "train"), (t + v, "validation")):
            test = (F.col(target) == k) & (F.col("__digest") <= cuts[(k, last)])
            split = F.when(test, name) if split is None else split.when(test, name)
    return marked.withColumn("split", split.otherwise("test")).drop("__digest")


def split_report(df: DataFrame, target: str) -> DataFrame:
    """Rows and class counts per partition."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(target) == 0).alias("negatives"),
        F.count_if(F.col(target) == 1).alias("positives"))


def class_weight(df: DataFrame, target: str) -> float:
    """Negatives per positive among the training rows."""
    row = df.where(F.col("split") == "train").agg(
        F.count_if(F.col(target) == 0).alias("neg"), F.count_if(F.col(target) == 1).alias("pos")).first()
    if not (row.neg and row.pos):
        raise ValidationError("Training partition must contain both classes")
    return row.neg / row.pos

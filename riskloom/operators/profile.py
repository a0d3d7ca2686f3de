"""Descriptive profiles: key figures, trends, categories, class summaries and distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.columns import (
    clip_upper, elapsed_bucket, elapsed_label, finite_or_null, known_category, parse_time, ratio,
)
from riskloom.errors import ValidationError
from riskloom.operators.quality import combined_copies, duplicate_rows, missing_by_column
from riskloom.operators.ranks import exact_quantiles
from riskloom.schema import RELATED_TARGET, WIDE_COMPONENTS, WIDE_FEATURES, WIDE_TARGET

AMOUNT_BINS = 10


def _labels(df: DataFrame, label: str) -> DataFrame:
    """Both class labels as rows, so that an empty class still shows up."""
    return df.sparkSession.range(2).select(F.col("id").cast("int").alias(label))


def kpi_overview(df: DataFrame, target: str, amount: str) -> DataFrame:
    """One row of key figures."""
    positive = F.count_if(F.col(target) == 1)
    return df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        positive.alias("fraud_transactions"),
        F.count_if(F.col(target) == 0).alias("legitimate_transactions"),
        ratio(positive, F.count(F.lit(1))).alias("fraud_rate"),
        F.sum(amount).alias("total_amount"),
        F.avg(amount).alias("average_amount"),
    )


def daily_trend(df: DataFrame, time: str, target: str) -> DataFrame:
    """Rows and positives per calendar day, days ascending; unreadable times are left out."""
    day = F.to_date(F.col(time)) if dict(df.dtypes)[time].startswith("timestamp") else F.to_date(parse_time(time))
    return (
        df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("transaction_count"), F.sum(target).alias("fraud_count"))
        .where(F.col("day").isNotNull()).orderBy("day")
    )


def elapsed_trend(df: DataFrame, seconds: str, target: str) -> DataFrame:
    """Rows and positives per two-hour bucket of elapsed seconds, buckets ascending."""
    return (
        df.groupBy(elapsed_bucket(F.col(seconds)).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("transaction_count"), F.sum(target).alias("fraud_count"))
        .withColumn("label", elapsed_label(F.col("bucket"))).orderBy("bucket")
    )


def category_summary(df: DataFrame, category: str, target: str, *, fill_unknown: bool = True) -> DataFrame:
    """Rows, positives and rate per category, categories ascending; null is its own category."""
    value = known_category(category) if fill_unknown else F.col(category)
    return (
        df.groupBy(value.alias("category"))
        .agg(F.count(F.lit(1)).alias("transaction_count"), F.sum(target).alias("fraud_count"))
        .withColumn("fraud_rate", ratio(F.col("fraud_count"), F.col("transaction_count"))).orderBy("category")
    )


def _moments(classed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation and maximum per class and column; columns become rows after the aggregate."""
    def finite(value: str) -> str:
        return f"CASE WHEN NOT isnan({value}) AND abs({value}) <> double('infinity') THEN {value} END"

    # One SQL text per column: tables with many components would spend longer on building expressions.
    cells = []
    for c in columns:
        x = f"nanvl(CAST(`{c}` AS DOUBLE), NULL)"
        cells.append(F.expr(
            f"named_struct('column_name', '{c}', 'value_count', count({x}), 'mean', {finite(f'avg({x})')}, "
            f"'deviation', stddev_samp({x}), 'highest', {finite(f'max({x})')})"))
    wide = classed.groupBy("label").agg(F.array(*cells).alias("cells"))
    return wide.select("label", F.explode("cells").alias("cell")).select("label", "cell.*")


def numeric_summary_by_class(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Per column and class: count, mean, median, 95th percentile and maximum, both classes always shown."""
    classed = df.where(F.col(target).isin(0, 1)).select(F.col(target).cast("int").alias("label"), *columns)
    quantiles = exact_quantiles(classed, columns, {"median": 0.5, "p95": 0.95}, ["label"]).drop("total")
    moments = _moments(classed, columns)
    frame = _labels(df, "label").select("label", F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name"))
    keys = ["label", "column_name"]
    # Both sides hold one row per class and named column, whatever the table size.
    return (
        frame.join(F.broadcast(moments), keys, "left").join(F.broadcast(quantiles), keys, "left")
        .select("column_name", "label", F.coalesce("value_count", F.lit(0)).alias("value_count"),
                "mean", "median", "p95", "highest")
    )


def component_stats(df: DataFrame, components: Sequence[str], target: str) -> DataFrame:
    """Per component and class: count, mean, sample deviation and median, from a wide table."""
    classed = df.where(F.col(target).isin(0, 1)).select(F.col(target).cast("int").alias("label"), *components)
    medians = exact_quantiles(classed, components, {"median": 0.5}, ["label"]).select("label", "column_name", "median")
    moments = _moments(classed, components)
    # One row per class and component on both sides.
    return moments.join(F.broadcast(medians), ["label", "column_name"], "left").select(
        F.col("column_name").alias("component"), "label", "value_count", "mean", "deviation", "median")


def amount_distribution(df: DataFrame, amount: str, target: str) -> DataFrame:
    """Ten equal bins up to the 95th percentile with rows per class; the last bin is open-ended."""
    upper = exact_quantiles(df, [amount], {"p95": 0.95}).first()
    top = upper.p95 if upper is not None else None
    if top is None or not top < float("inf") or top <= 0:
        highest = df.agg(F.max(finite_or_null(amount))).first()[0]
        top = highest if highest is not None and highest > 0 else 1.0
    edges = [i * (top / AMOUNT_BINS) for i in range(AMOUNT_BINS)] + [top]
    value = clip_upper(F.col(amount), top)
    number = sum(((value >= F.lit(edge)).cast("int") for edge in edges[1:-1]), F.lit(0))
    counts = df.groupBy(number.alias("bin")).agg(
        F.count_if(F.col(target) == 0).alias("legitimate"), F.count_if(F.col(target) == 1).alias("fraud"))
    bins = df.sparkSession.range(AMOUNT_BINS).select(
        F.col("id").cast("int").alias("bin"),
        F.element_at(F.array(*[F.lit(e) for e in edges[:-1]]), F.col("id").cast("int") + 1).alias("lower"),
        F.element_at(F.array(*[F.lit(e) for e in edges[1:]]), F.col("id").cast("int") + 1).alias("upper"),
    )
    return bins.join(F.broadcast(counts), "bin", "left").select(  # at most ten rows
        "bin", "lower", F.when(F.col("bin") < AMOUNT_BINS - 1, F.col("upper")).alias("upper"),
        F.coalesce("legitimate", F.lit(0)).alias("legitimate"), F.coalesce("fraud", F.lit(0)).alias("fraud"),
    ).orderBy("bin")


def density_histogram(df: DataFrame, value: str, target: str, bins: int) -> DataFrame:
    """Density per class over equal bins from that class's minimum to its maximum, last bin closed."""
    classed = df.select(F.col(target).cast("int").alias("label"), finite_or_null(value).alias("v")).where(
        F.col("label").isin(0, 1) & F.col("v").isNotNull())
    low, high = F.min("v"), F.max("v")
    spans = {r.label: (r.low, r.high, r.n) for r in classed.groupBy("label").agg(
        low.alias("low"), high.alias("high"), F.count(F.lit(1)).alias("n")).collect()}
    if not spans:
        raise ValidationError(f"No finite values to bin in {value}")
    # At most two classes, so their ranges are literals in the plan.
    flat = {k: (lo - 0.5, hi + 0.5, n) if lo == hi else (lo, hi, n) for k, (lo, hi, n) in spans.items()}

    def per_class(index: int):
        choice = F.lit(None).cast("double")
        for label, parts in flat.items():
            choice = F.when(F.col("label") == label, F.lit(float(parts[index]))).otherwise(choice)
        return choice

    start = per_class(0)
    width = (per_class(1) - per_class(0)) / bins
    placed = classed.select("label", "v", start.alias("start"), width.alias("width"),
                            F.least(F.floor((F.col("v") - start) / width), F.lit(bins - 1)).cast("int").alias("guess"))
    # The division can miss by one on an edge, so the guess is settled against the edges themselves.
    below = F.col("v") < F.col("guess") * F.col("width") + F.col("start")
    above = (F.col("guess") < bins - 1) & (F.col("v") >= (F.col("guess") + 1) * F.col("width") + F.col("start"))
    number = F.col("guess") + F.when(below, -1).when(above, 1).otherwise(0)
    counts = placed.groupBy("label", number.alias("bin")).agg(F.count(F.lit(1)).alias("row_count"))
    frame = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), F.explode(F.array(*[F.lit(k) for k in sorted(flat)])).alias("label"))
    filled = frame.join(F.broadcast(counts), ["label", "bin"], "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
    return filled.select(
        "label", "bin", (F.col("bin") * width + start).alias("lower"), "row_count",
        (F.col("row_count") / (per_class(2) * width)).alias("density"),
    ).orderBy("label", "bin")


def table_profile(df: DataFrame, target: str, time: str) -> DataFrame:
    """One row: rows, columns, class counts, rate, imbalance, missing, duplicates, time range, unread times."""
    is_time = dict(df.dtypes)[time].startswith("timestamp")
    columns = len(df.columns)
    parsed = F.col(time) if is_time else parse_time(time)
    n = F.col("__copies")
    return combined_copies(df).agg(
        F.sum(n).alias("row_count"),
        F.lit(columns).cast("long").alias("column_count"),
        F.sum(F.when(F.col(target) == 0, n).otherwise(0)).alias("negatives"),
        F.sum(F.when(F.col(target) == 1, n).otherwise(0)).alias("positives"),
        ratio(F.sum(F.when(F.col(target) == 1, n).otherwise(0)), F.sum(n)).alias("fraud_rate"),
        ratio(F.sum(F.when(F.col(target) == 0, n).otherwise(0)),
              F.sum(F.when(F.col(target) == 1, n).otherwise(0))).alias("imbalance"),
        F.sum(n * F.col("__missing")).alias("missing_cells"),
        F.sum(n - 1).alias("duplicate_rows"),
        F.min(parsed).alias("time_min"), F.max(parsed).alias("time_max"),
        F.sum(F.when(parsed.isNull(), n).otherwise(0)).alias("unparsed_times"),
    )



def wide_profiles(df: DataFrame) -> dict[str, DataFrame]:
    """Every descriptive table of the wide data set, by name."""
    columns = [WIDE_TARGET, *WIDE_FEATURES]
    if missing := [c for c in columns if c not in df.columns]:
        raise ValidationError(f"The wide table is missing columns needed for profiling: {missing}")
    return {
        "overview": kpi_overview(df, WIDE_TARGET, "Amount"),
        "missing": missing_by_column(df),
        "duplicates": duplicate_rows(df),
        "by_class": numeric_summary_by_class(df, ["Amount", "Time"], WIDE_TARGET),
        "components": component_stats(df, list(WIDE_COMPONENTS), WIDE_TARGET),
        "trend": elapsed_trend(df, "Time", WIDE_TARGET),
        "amount_distribution": amount_distribution(df, "Amount", WIDE_TARGET),
        "amount_density": density_histogram(df, "Amount", WIDE_TARGET, 40),
        "time_density": density_histogram(df, "Time", WIDE_TARGET, 40),
    }


def related_profiles(df: DataFrame) -> dict[str, DataFrame]:
    """Every descriptive table of the joined transaction table, by name."""
    columns = [RELATED_TARGET, "Amount", "TransactionAmount", "Timestamp", "Category"]
    if missing := [c for c in columns if c not in df.columns]:
        raise ValidationError(f"The transaction table is missing columns needed for profiling: {missing}")
    return {
        "overview": kpi_overview(df, RELATED_TARGET, "Amount"),
        "profile": table_profile(df, RELATED_TARGET, "Timestamp"),
        "missing": missing_by_column(df),
        "by_class": numeric_summary_by_class(df, ["Amount", "TransactionAmount"], RELATED_TARGET),
        "trend": daily_trend(df, "Timestamp", RELATED_TARGET),
        "categories": category_summary(df, "Category", RELATED_TARGET),
        "amount_distribution": amount_distribution(df, "Amount", RELATED_TARGET),
        "amount_density": density_histogram(df, "Amount", RELATED_TARGET, 25),
    }


__all__ = [
    "amount_distribution", "category_summary", "component_stats", "daily_trend", "density_histogram", "elapsed_trend",
    "kpi_overview", "missing_by_column", "numeric_summary_by_class", "related_profiles", "table_profile", "wide_profiles",
]

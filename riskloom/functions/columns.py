"""Scalar column expressions: coercion, calendar parts, buckets, bands and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from riskloom.errors import ValidationError
from riskloom.schema import MISSING_TOKENS

# Fixed value: the text forms accepted as numbers when a string column is coerced.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"
SECONDS_PER_TREND_BUCKET = 7200


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: str | Column) -> Column:
    """String cell with the usual missing-value tokens turned into null."""
    cell = _column(value)
    return F.when(F.trim(cell).isin(*MISSING_TOKENS), None).otherwise(cell)


def to_number(value: str | Column) -> Column:
    """Text to double; null when the text is not a plain decimal number or infinity."""
    cell = _column(value).cast("string")
    return F.when(cell.rlike(NUMBER_PATTERN), cell.try_cast("double"))


def is_missing(value: str | Column, dtype: str) -> Column:
    """Null, or NaN for floating columns."""
    cell = _column(value)
    return cell.isNull() | F.isnan(cell) if dtype in ("double", "float") else cell.isNull()


def is_infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(math.inf)


def finite_or_null(value: str | Column) -> Column:
    """NaN and infinities become null."""
    cell = _column(value).cast("double")
    return F.when(F.isnan(cell) | is_infinite(cell), None).otherwise(cell)


def parse_time(value: str | Column) -> Column:
    """Timestamp or null when the text cannot be parsed."""
    return F.try_to_timestamp(_column(value).cast("string"))


def calendar_parts(time: Column) -> dict[str, Column]:
    """Hour, weekday (Monday is 0) and month as doubles."""
    return {
        "hour": F.hour(time).cast("double"),
        "day_of_week": F.weekday(time).cast("double"),
        "month": F.month(time).cast("double"),
    }


def epoch_seconds(time: str | Column) -> Column:
    """Timestamp as seconds since 1970, independent of the session time zone for zone-less times."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _column(time)) / 1e6


def elapsed_bucket(seconds: Column) -> Column:
    """Number of the two-hour bucket holding an elapsed time."""
    return F.floor(seconds / SECONDS_PER_TREND_BUCKET).cast("int")


def elapsed_label(bucket: Column) -> Column:
    return F.format_string("%02d–%02d h", bucket * 2, bucket * 2 + 2)


def clip_upper(value: Column, upper: float | Column) -> Column:
    return F.least(value, upper if isinstance(upper, Column) else F.lit(float(upper)))


def known_category(value: str | Column) -> Column:
    """Category text with nulls shown as Unknown."""
    return F.coalesce(_column(value).cast("string"), F.lit("Unknown"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def zero_safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, zero when the denominator is zero."""
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def display_name(value: str | Column) -> Column:
    return F.initcap(F.replace(_column(value), F.lit("_"), F.lit(" ")))


def check_bands(low_upper: float, medium_upper: float) -> None:
    if not (math.isfinite(low_upper) and math.isfinite(medium_upper) and 0 < low_upper < medium_upper < 100):
        raise ValidationError("Risk bands must satisfy 0 < low_upper < medium_upper < 100")


def risk_level(score: str | Column, low_upper: float = 30.0, medium_upper: float = 70.0) -> Column:
    """Band of a 0-100 score: low, medium or high."""
    check_bands(low_upper, medium_upper)
    value = _column(score)
    return F.when(value < low_upper, "low").when(value < medium_upper, "medium").otherwise("high")


def as_percent(probability: str | Column) -> Column:
    return _column(probability) * 100.0


def is_alert(score: str | Column, threshold: float = 0.5) -> Column:
    """Fixed-threshold decision, threshold included."""
    if not (math.isfinite(threshold) and 0 <= threshold <= 1):
        raise ValidationError("Decision threshold must be between 0 and 1")
    return _column(score) >= F.lit(float(threshold))


def case_id(value: str | Column) -> Column:
    """Caller-given identifier as trimmed text of 1 to 128 characters, else null."""
    text = F.trim(_column(value).cast("string"))
    return F.when(F.length(text).between(1, 128), text)

"""Strict checks of raw transactions, as typed columns or as JSON text.

Reasons name the field and the broken rule, never the submitted value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from riskloom.errors import ValidationError
from riskloom.functions.columns import case_id, is_infinite
from riskloom.schema import WIDE_FEATURES

NON_NEGATIVE = ("Time", "Amount")


def _first_reason(rules: Sequence[tuple[Column, str | Column]]) -> Column:
    """Reason of the first broken rule, else null."""
    reasons = [F.when(F.coalesce(broken, F.lit(True)), text if isinstance(text, Column) else F.lit(text)) for broken, text in rules]
    return F.coalesce(*reasons)


def typed_reason(df: DataFrame, features: Sequence[str] = WIDE_FEATURES, non_negative: Sequence[str] = NON_NEGATIVE,
                 ignore: Sequence[str] = ()) -> Column:
    """Reject reason of rows whose features are columns; column names and types are checked at once."""
    present = [c for c in df.columns if c not in ignore]
    if missing := sorted(set(features) - set(present)):
        raise ValidationError(f"Transactions are missing required features: {missing}")
    if extra := sorted(set(present) - set(features)):
        raise ValidationError(f"Transactions contain unsupported fields: {extra}")
    types = {f.name: f.dataType for f in df.schema}
    for c in features:
        if not isinstance(types[c], T.NumericType):
            raise ValidationError(f"Feature {c} must be a numeric value")
    rules: list[tuple[Column, str]] = []
    for c in features:
        x = F.col(c).cast("double")
        rules.append((x.isNull(), f"feature {c} must be a numeric value"))
        rules.append((F.isnan(x) | is_infinite(x), f"feature {c} must be finite"))
        if c in non_negative:
            rules.append((x < 0, f"feature {c} cannot be negative"))
    return _first_reason(rules)


def parse_payloads(df: DataFrame, payload: str, features: Sequence[str] = WIDE_FEATURES,
                   non_negative: Sequence[str] = NON_NEGATIVE) -> DataFrame:
    """Adds `reject_reason` (null when valid) and one double column per feature from JSON objects.

    Keys must match the features exactly, and values must be JSON numbers: text and booleans that
    merely look like numbers are refused.
    """
    # The parser stops after the first value; inside an array and inside an object nothing can follow it unseen.
    nested = F.try_parse_json(F.concat(F.lit('{"p":'), F.col(payload), F.lit("}")))
    alone = nested.isNotNull() & F.try_variant_get("__listed", "$[1]", "variant").isNull()
    parsed = df.withColumn("__listed", F.try_parse_json(F.concat(F.lit("["), F.col(payload), F.lit("]"))))
    parsed = parsed.withColumn("__v", F.when(alone, F.try_variant_get("__listed", "$[0]", "variant")))
    parsed = parsed.withColumn("__keys", F.when(F.schema_of_variant("__v").startswith("OBJECT<"), F.json_object_keys(payload)))
    # Kinds and values are columns of their own: each is taken from the variant once, however many rules name it.
    taken = {}
    for i, f in enumerate(features):
        taken[f"__kind_{i}"] = F.schema_of_variant(F.try_variant_get("__v", f"$.{f}", "variant"))
        taken[f"__value_{i}"] = F.try_variant_get("__v", f"$.{f}", "double")
    parsed = parsed.withColumns(taken)
    expected = F.array(*[F.lit(f) for f in features])
    missing = F.array_sort(F.array_except(expected, F.col("__keys")))
    extra = F.array_sort(F.array_except(F.col("__keys"), expected))
    rules: list[tuple[Column, str | Column]] = [
        (F.col("__keys").isNull(), "payload must be a JSON object"),
        (F.size(missing) > 0, F.concat(F.lit("missing required features: "), F.array_join(missing, ", "))),
        # Foreign key names come from the caller, so they are counted rather than repeated.
        (F.size(extra) > 0, F.concat(F.size(extra).cast("string"), F.lit(" unsupported field(s)"))),
    ]
    values = {}
    for i, f in enumerate(features):
        kind, value = F.col(f"__kind_{i}"), F.col(f"__value_{i}")
        rules.append((~F.coalesce(kind.rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False)), f"feature {f} must be a numeric value"))
        rules.append((value.isNull() | is_infinite(value), f"feature {f} must be finite"))
        if f in non_negative:
            rules.append((value < 0, f"feature {f} cannot be negative"))
        values[f] = value
    out = parsed.withColumn("reject_reason", _first_reason(rules))
    told = F.struct("reject_reason", *[F.when(F.col("reject_reason").isNull(), v).alias(f) for f, v in values.items()])
    # A filter on a generated column stays above it; pushed into the parsing, it would parse a payload once for each mention.
    kept = [f"`{c}`" for c in df.columns if c not in ("reject_reason", *features)]
    return out.select(*kept, F.explode(F.array(told)).alias("__told")).select(*kept, "__told.*")


def split_rejects(df: DataFrame, *, atomic: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows of a frame with `reject_reason`; atomic batches raise instead."""
    accepted = df.where(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = df.where(F.col("reject_reason").isNotNull())
    if atomic:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.count("reject_reason").alias("bad"), F.min("reject_reason").alias("why")).first()
        if not row.n:
            raise ValidationError("transactions must contain at least one transaction")
        if row.bad:
            raise ValidationError(f"{row.bad} transaction(s) rejected: {row.why}")
    return accepted, rejected


def case_ids(df: DataFrame, column: str) -> DataFrame:
    """Adds `case_id`; only text and whole-number columns may hold identifiers, bad ones are null."""
    kind = {f.name: f.dataType for f in df.schema}[column]
    if not isinstance(kind, (T.StringType, T.IntegralType)):
        raise ValidationError("transaction_id must be a non-empty string or integer")
    return df.withColumn("case_id", case_id(column))


def require_case_ids(df: DataFrame, column: str) -> DataFrame:
    out = case_ids(df, column)
    if out.where(F.col("case_id").isNull()).limit(1).count():
        raise ValidationError("transaction_id must contain 1 to 128 characters")
    return out

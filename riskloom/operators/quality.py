"""Table checks: shape, missing cells, duplicates, label domains, numeric coercion, ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.errors import ValidationError
from riskloom.functions.columns import finite_or_null, is_infinite, is_missing, to_number
from riskloom.schema import Contract

EXAMPLES = 20


def column_problems(present: Sequence[str], contract: Contract) -> list[str]:
    """Differences between present and declared columns, from metadata only."""
    here, declared = list(present), contract.names
    found = [f"lacks {c!r}" for c in declared if c not in here] + [f"has undeclared {c!r}" for c in here if c not in declared]
    return found or (["has its columns in another order"] if "ordered" in contract.traits and here != declared else [])


def require_columns(df: DataFrame, columns: Sequence[str], table: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValidationError(f"Table {table} is missing required columns: {missing}")


def _types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def combined_copies(df: DataFrame, digest: Sequence[str] = ()) -> DataFrame:
    """One row per distinct row with its number of copies and missing cells.

    Copies are combined before the shuffle, so a hot group of copies costs one row per task. Long
    text columns named in `digest` are compared by SHA-256, which keeps whole texts out of the
    shuffle while still covering all of their characters.
    """
    types = _types(df)
    missing = sum((is_missing(c, types[c]).cast("int") for c in df.columns), F.lit(0))
    keys = [F.sha2(F.col(c), 256).alias(c) if c in digest else F.col(c) for c in df.columns]
    return (
        df.select(*keys, missing.alias("__missing"))
        .groupBy(*df.columns, "__missing").agg(F.count(F.lit(1)).alias("__copies"))
    )


def duplicate_rows(df: DataFrame, digest: Sequence[str] = ()) -> DataFrame:
    """Exact duplicates (rows minus distinct rows) as one row: total_rows, distinct_rows, duplicate_rows."""
    return combined_copies(df, digest).agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def table_report(df: DataFrame, name: str, digest: Sequence[str] = ()) -> DataFrame:
    """One row per table: rows, columns, missing cells and duplicate rows, in one pass."""
    return combined_copies(df, digest).agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("__copies") * F.col("__missing")), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"),
    ).select(
        F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"),
        "missing_cells", "duplicate_rows",
    )


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def tables_report(tables: Mapping[str, DataFrame], digest: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per-table quality rows plus their sum in a row named 'all'."""
    digest = digest or {}
    each = stack([table_report(df, name, digest.get(name, ())) for name, df in tables.items()])
    totals = [F.sum(c).alias(c) for c in ("row_count", "column_count", "missing_cells", "duplicate_rows")]
    # `each` holds one row per table, so a grouping set over it replaces a second scan of the tables.
    return each.rollup("table_name").agg(*totals).withColumn("table_name", F.coalesce("table_name", F.lit("all")))


def missing_by_column(df: DataFrame) -> DataFrame:
    """Long form (column_name, missing_cells), from one aggregate."""
    types = _types(df)
    counts = df.agg(*[F.count_if(is_missing(c, types[c])).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "missing_cells")


def target_distribution(df: DataFrame, target: str, domain: Sequence[int] = (0, 1)) -> DataFrame:
    """Rows per label value with a flag telling whether the value is allowed."""
    return (
        df.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn("is_valid", F.coalesce(F.col("label").isin(*domain), F.lit(False)))
    )


def require_target(df: DataFrame, target: str, *, both_classes: bool = True) -> dict[int, int]:
    """Counts per class; raises for null or foreign labels, or when a class is absent."""
    value = F.col(target)
    row = df.agg(
        F.count_if(~F.coalesce(value.isin(0, 1), F.lit(False))).alias("invalid"),
        F.count_if(value == 0).alias("negative"), F.count_if(value == 1).alias("positive"),
    ).first()
    if row.invalid:
        bad = df.where(~F.coalesce(value.isin(0, 1), F.lit(False))).select(value).distinct().limit(EXAMPLES).collect()
        raise ValidationError(
            f"Target {target} must contain only non-null 0/1 values; invalid values: {sorted(str(r[0]) for r in bad)}"
        )
    if both_classes and not (row.negative and row.positive):
        raise ValidationError(f"Target {target} must contain both classes 0 and 1")
    return {0: row.negative, 1: row.positive}


def numeric_coercion(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: cells, non-missing cells, cells that are not numbers, infinite cells."""
    types = dict(df.dtypes)
    aggregates = []
    for c in columns:
        number = to_number(c) if types[c] == "string" else F.col(c).try_cast("double")
        aggregates.append(F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.lit(1)).alias("cells"),
            F.count(F.col(c)).alias("non_null"),
            F.count_if(~is_missing(c, types[c]) & number.isNull()).alias("non_numeric"),
            F.count_if(is_infinite(number)).alias("infinite"),
        ))
    return df.agg(F.array(*aggregates).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def require_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles; raises when a cell is not a number or is infinite.

    Columns that already hold numbers keep their plain form, so later plans stay small.
    """
    types = _types(df)
    text = [c for c in columns if types[c] == "string"]
    numbers = [c for c in columns if c not in text]
    problems = {r.column_name: r for r in numeric_coercion(df, text).collect()} if text else {}
    for c in text:
        if problems[c].non_numeric:
            raise ValidationError(f"Feature {c} contains non-numeric values")
        if problems[c].infinite:
            raise ValidationError(f"Feature {c} contains infinite values")
    if numbers:
        row = df.agg(*[F.count_if(is_infinite(F.col(c).cast("double"))).alias(c) for c in numbers]).first()
        for c in numbers:
            if row[c]:
                raise ValidationError(f"Feature {c} contains infinite values")
    casts = {c: to_number(c) for c in text} | {c: F.col(c).cast("double") for c in numbers if types[c] != "double"}
    return df.withColumns(casts) if casts else df


def check_table(df: DataFrame, contract: Contract, *, duplicate_policy: str = "report", digest: Sequence[str] = ()) -> dict:
    """Counts of the table; raises with all breaches of its contract at once.

    Everything is counted on distinct rows with their copies, so a hot group of copies costs one row per task.
    """
    if duplicate_policy not in ("report", "error"):
        raise ValueError("duplicate_policy must be 'report' or 'error'")
    if problems := column_problems(df.columns, contract):
        raise ValidationError(f"{contract.name} {', '.join(problems)}")
    types, label, n = _types(df), contract.label, F.col("__copies")
    copies = combined_copies(df.withColumns({f"__m_{c}": is_missing(c, types[c]) for c in df.columns}), digest)
    count = lambda test, name: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).alias(name)
    labels = {v: f"__label_{i}" for i, v in enumerate(label.metadata["labels"])} if label else {}
    row = copies.agg(
        count(F.lit(True), "__rows"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("__repeated"), *[count(F.col(f"__m_{c}"), c) for c in df.columns],
        *[count(F.col(label.name) == v, name) for v, name in labels.items()]).first()
    gaps = {c: row[c] for c in df.columns if row[c]}
    least, most = contract.rows
    strange = row["__rows"] - sum(row[name] for name in labels.values()) if label else 0
    breaches = {
        f"{row['__rows']} rows where {least} to {'any number' if most is None else most} are wanted": not least <= row["__rows"] <= (most if most is not None else row["__rows"]),
        f"cells without value {gaps}": gaps and "gaps" not in contract.traits,
        f"{strange} labels other than {list(labels)}": strange,
        f"{row['__repeated']} repeated rows": row["__repeated"] and duplicate_policy == "error",
    }
    if told := [text for text, broken in breaches.items() if broken]:
        raise ValidationError(f"{contract.name}: {'; '.join(told)}")
    return {
        "table_name": contract.name, "row_count": row["__rows"], "columns": list(df.columns), "missing_values": gaps,
        "duplicate_rows": row["__repeated"], "target_distribution": {v: row[name] for v, name in labels.items() if row[name]},
    }


def quality_checks(df: DataFrame, target: str, time: str, amount: str, digest: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """One row per check (check_name, status, detail) for a wide numeric table held as text or numbers.

    columns: those the table should have, by default its own.
    """
    types = _types(df)
    text = [c for c in df.columns if c not in digest]
    numbers = {c: to_number(c) for c in text}
    bad_number = sum((F.when(F.col(c).isNotNull() & ~is_missing(c, types[c]) & numbers[c].isNull(), 1).otherwise(0)
                      for c in text), F.lit(0))
    infinite = sum((F.when(is_infinite(numbers[c]), 1).otherwise(0) for c in text), F.lit(0))
    missing = sum((is_missing(c, types[c]).cast("int") for c in df.columns), F.lit(0))
    keys = [F.sha2(F.col(c), 256).alias(c) if c in digest else F.col(c) for c in df.columns]
    n = F.col("n")
    # Cell counts depend only on the row's content, so they are combined per distinct row as well.
    totals = (
        df.select(*keys, bad_number.alias("bad"), infinite.alias("inf"), missing.alias("miss"))
        .groupBy(*df.columns, "bad", "inf", "miss").agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum(n).alias("total"), F.sum(n - 1).alias("duplicates"), F.sum(n * F.col("miss")).alias("missing"),
            F.sum(n * F.col("bad")).alias("bad"), F.sum(n * F.col("inf")).alias("infinite"),
            F.min(finite_or_null(numbers[time])).alias("time_min"),
            F.min(finite_or_null(numbers[amount])).alias("amount_min"),
            F.sum(F.when(F.col(target) == 1, n).otherwise(0)).alias("positive"),
            F.sum(F.when(F.col(target) == 0, n).otherwise(0)).alias("negative"),
        )
    )
    clean = (F.col("bad") == 0) & (F.col("infinite") == 0)
    in_range = F.coalesce((F.col("time_min") >= 0) & (F.col("amount_min") >= 0) & clean, F.lit(False))

    def check(name: str, status: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), status.alias("status"), detail.alias("detail"))

    def state(good: Column, otherwise: str) -> Column:
        return F.when(good, "passed").otherwise(otherwise)

    unlike = sorted({*df.columns} ^ {*(df.columns if columns is None else columns)})
    other = F.col("total") - F.col("positive") - F.col("negative")
    both = (F.col("positive") > 0) & (F.col("negative") > 0)
    rows = F.array(
        check("columns", state(F.lit(not unlike), "failed"), F.lit(f"absent or undeclared: {len(unlike)}")),
        check("gaps", state(F.col("missing") == 0, "warning"), F.format_string("cells: %d", "missing")),
        check("repeated rows", state(F.col("duplicates") == 0, "warning"), F.format_string("rows: %d", "duplicates")),
        check("numbers", state(clean, "failed"), F.format_string("unreadable: %d, infinite: %d", "bad", "infinite")),
        check("ranges", state(in_range, "failed"), F.format_string("below zero: %s", F.concat_ws(
            ", ", F.when(F.col("time_min") < 0, time), F.when(F.col("amount_min") < 0, amount)))),
        check("labels", F.when(other > 0, "failed").when(both, "passed").otherwise("warning"),
              F.format_string("zero: %d, one: %d, other: %d", "negative", "positive", other)),
    )
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest finite value per column."""
    row = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.min(finite_or_null(to_number(c))).alias("lowest"),
                 F.max(finite_or_null(to_number(c))).alias("highest"))
        for c in columns
    ])
    return df.agg(row.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def overview_guard(df: DataFrame, target: str, amount: str) -> None:
    """Every label is 0/1 and every amount a finite number."""
    valid = F.col(target).isin(0, 1) & finite_or_null(to_number(amount)).isNotNull()
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("bad")).first()
    if not row.n:
        raise ValidationError("The table has no usable transaction rows")
    if row.bad:
        raise ValidationError("The table contains invalid target or amount values")


def metric_range_problems(df: DataFrame, unit: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Rows whose metrics leave [0, 1] or whose counts are negative."""
    bad = F.lit(False)
    for c in unit:
        bad = bad | ~F.coalesce(F.col(c).between(0, 1) & ~F.isnan(c), F.lit(False))
    for c in counts:
        bad = bad | ~F.coalesce(F.col(c) >= 0, F.lit(False))
    return df.where(bad)

"""Key checks, foreign-key audits and grain-preserving joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskloom.errors import ValidationError
from riskloom.functions.columns import display_name
from riskloom.operators.quality import require_columns, require_target, stack, tables_report
from riskloom.schema import PERSONAL_COLUMNS, RELATED_TARGET, TRANSACTION_KEY, related_specs
from riskloom.session import cut_lineage


@dataclass(frozen=True)
class Relation:
    """A reference from one table's key to another table's unique key."""

    source: str
    target: str
    key: str
    one_to_one: bool = False
    target_key: str | None = None

    @property
    def cardinality(self) -> str:
        return "one-to-one" if self.one_to_one else "many-to-one"


def key_audit(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row: rows, rows with a null key part, and duplicate keys (rows minus distinct keys).

    Keys are combined first, so one hot key is a single row per map task.
    """
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    combined = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return combined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(null_key, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.when(~null_key, F.col("n") - 1)), F.lit(0)).alias("duplicate_keys"),
    ).select(F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
             "row_count", "null_keys", "duplicate_keys")


def require_key(df: DataFrame, key: str, name: str, *, unique: bool) -> int:
    """Row count of a table whose key is never null (and unique when asked)."""
    require_columns(df, [key], name)
    row = key_audit(df, [key], name).first()
    if row.null_keys:
        raise ValidationError(f"{name}: {row.null_keys} rows without {key}")
    if unique and row.duplicate_keys:
        raise ValidationError(f"{name}: {row.duplicate_keys} rows repeat {key}")
    return row.row_count


def relation_facts(source: DataFrame, target: DataFrame, relation: Relation) -> DataFrame:
    """One row of everything an audit needs, in one job.

    Both sides are combined to one row per key before they meet, so no key is hot in the join.
    """
    left = source.groupBy(F.col(relation.key).alias("key")).agg(F.count(F.lit(1)).alias("source_rows"))
    right = target.groupBy(F.col(relation.target_key or relation.key).alias("key")).agg(F.count(F.lit(1)).alias("target_rows"))
    here, there = F.col("source_rows"), F.col("target_rows")
    known = F.col("key").isNotNull()

    def total(amount, test):
        return F.coalesce(F.sum(F.when(test, amount)), F.lit(0))

    return left.join(right, "key", "full_outer").agg(
        F.coalesce(F.sum(here), F.lit(0)).alias("source_count"),
        total(here, ~known).alias("source_nulls"), total(there, ~known).alias("target_nulls"),
        total(here - 1, known).alias("source_duplicates"), total(there - 1, known).alias("target_duplicates"),
        F.count_if(known & here.isNotNull() & there.isNotNull()).alias("matched"),
        F.count_if(known & there.isNull()).alias("unmatched"),
        F.count_if(known & here.isNull()).alias("unreferenced"),
    ).select(
        F.lit(relation.source).alias("source_table"), F.lit(relation.target).alias("target_table"),
        F.lit(relation.key).alias("key_column"), F.lit(relation.cardinality).alias("cardinality"), "*",
    )


AUDIT_COLUMNS = ("source_table", "target_table", "key_column", "cardinality", "matched", "unmatched", "unreferenced")


def _with_status(facts: DataFrame) -> DataFrame:
    complete = (F.col("unmatched") == 0) & (F.col("unreferenced") == 0)
    return facts.select(*AUDIT_COLUMNS, F.when(complete, "passed").otherwise("warning").alias("status"))


def relationship_audit(source: DataFrame, target: DataFrame, relation: Relation) -> DataFrame:
    """One row: matched, unmatched and unreferenced keys, with a status."""
    return _with_status(relation_facts(source, target, relation))


def relationships_report(tables: Mapping[str, DataFrame], relations: Sequence[Relation]) -> DataFrame:
    """All audits stacked, with table names as shown to readers."""
    audits = stack([relationship_audit(tables[r.source], tables[r.target], r) for r in relations])
    return audits.withColumns({c: display_name(c) for c in ("source_table", "target_table")})


def unmatched_examples(source: DataFrame, target: DataFrame, key: str, target_key: str | None = None, limit: int = 5) -> DataFrame:
    """First keys of `source` absent from `target`, in text order."""
    wanted = target.select(F.col(target_key or key).alias("key"))
    return (
        source.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).join(wanted, "key", "left_anti").distinct()
        .orderBy(F.col("key").cast("string")).limit(limit)
    )


def breaches(row, relation: Relation) -> dict[str, int]:
    """Rows or keys that break a relation, by kind; kinds without any are left out."""
    counts = {
        f"{relation.source} without {relation.key}": row.source_nulls,
        f"{relation.target} without {relation.target_key or relation.key}": row.target_nulls,
        f"{relation.target} repeating {relation.target_key or relation.key}": row.target_duplicates,
        f"{relation.source} repeating {relation.key}": row.source_duplicates if relation.one_to_one else 0,
        f"{relation.key} of {relation.source} not in {relation.target}": row.unmatched,
        f"{relation.target_key or relation.key} of {relation.target} not in {relation.source}": row.unreferenced if relation.one_to_one else 0,
    }
    return {kind: n for kind, n in counts.items() if n}


def _keys_shown(row, relation: Relation, tables: Mapping[str, DataFrame]) -> list:
    """A few of the keys that one side lacks."""
    source, target, keys = tables[relation.source], tables[relation.target], (relation.key, relation.target_key or relation.key)
    lacking = unmatched_examples(source, target, *keys) if row.unmatched else unmatched_examples(target, source, *reversed(keys))
    return [r.key for r in lacking.collect()] if row.unmatched or relation.one_to_one and row.unreferenced else []


def require_relations(tables: Mapping[str, DataFrame], relations: Sequence[Relation]) -> DataFrame:
    """Audits all relations in one job; raises with all breaches of the first broken relation in the given order.

    Nulls, duplicates on the unique side, unmatched keys and orphans of 1:1 tables are breaches.
    """
    # Two relations may join the same pair of tables by different keys, so each fact carries its relation's place.
    facts = stack([relation_facts(tables[r.source], tables[r.target], r).withColumn("place", F.lit(i)) for i, r in enumerate(relations)])
    ordered = sorted(facts.collect(), key=lambda r: r.place)
    for relation, row in zip(relations, ordered, strict=True):
        if found := breaches(row, relation):
            raise ValidationError(f"{relation.source} -> {relation.target}: {found}, keys such as {_keys_shown(row, relation, tables)}")
    audit = facts.sparkSession.createDataFrame([tuple(r) for r in ordered], facts.schema)
    return _with_status(audit)


def attach(left: DataFrame, right: DataFrame, on: str, columns: Sequence[str], right_key: str | None = None) -> DataFrame:
    """Left equi-join to a table whose key was proven unique, taking only the named columns.

    No broadcast is forced: the optimizer broadcasts when statistics or the run-time size allow it,
    and otherwise adaptive execution splits a hot left key across tasks (the right side has one row
    per key, so splitting is always possible).
    """
    if personal := sorted(set(columns) & set(PERSONAL_COLUMNS)):
        raise ValidationError(f"Personal columns must not be joined: {personal}")
    side = right.select(F.col(right_key or on).alias(on), *columns)
    return left.join(side, on, "left")


def require_grain(df: DataFrame, key: str, expected_rows: int) -> None:
    row = key_audit(df, [key], "joined").first()
    if row.row_count != expected_rows or row.duplicate_keys or row.null_keys:
        raise ValidationError(f"the join has {row.row_count} rows, {row.duplicate_keys} repeated, for {expected_rows} transactions")


def changed_targets(joined: DataFrame, source: DataFrame, key: str, target: str) -> DataFrame:
    """Joined rows whose label differs from the label table."""
    original = source.select(key, F.col(target).alias("__original"))
    return joined.select(key, target).join(original, key).where(~F.col(target).eqNullSafe(F.col("__original")))


# The relations among the ten related tables, in audit order.
RELATED_RELATIONS = (
    *(Relation("transaction_records", t, "TransactionID", one_to_one=True) for t in (
        "transaction_metadata", "fraud_indicators", "transaction_category_labels", "amount_data", "anomaly_scores")),
    *(Relation("transaction_records", t, "CustomerID") for t in (
        "customer_data", "account_activity", "suspicious_activity")),
    Relation("transaction_metadata", "merchant_data", "MerchantID"),
)


#: Transactions of one task of the star's aggregate: what it sorts does not grow with the tables.
ROWS_A_TASK = 300_000
#: Rows without key are dealt into so many groups.
_WITHOUT_KEY = 64


def tagged_rows(tables: Mapping[str, DataFrame], key: str, columns: Mapping[str, Sequence[str]], tasks: int | None = None) -> DataFrame:
    """One row for each key found in any table: rows of it in each table (n0, n1, ...), and the named columns.

    All tables meet in one aggregate: one shuffle, in which hot and missing keys are combined first. A column's value is
    its greatest one, which is its only one wherever the count of its table is 1. For keys that hardly repeat, name the
    number of `tasks`: rows are then dealt out to them as they are, since combining would only sort every input once more.
    Missing keys come as several rows in that case.
    """
    parts = [tables[name].select(F.col(key), F.lit(i).alias("tag"), *columns.get(name, ())) for i, name in enumerate(tables)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    groups = [key]
    if tasks:
        dealt = F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(_WITHOUT_KEY))).otherwise(F.lit(0))
        groups.append("__dealt")
        union = union.withColumn("__dealt", dealt).repartition(tasks, *groups)
    named = [c for name in tables for c in columns.get(name, ())]
    return union.groupBy(*groups).agg(*[F.count_if(F.col("tag") == i).alias(f"n{i}") for i in range(len(parts))], *[F.max(c).alias(c) for c in named]).drop("__dealt")


def tagged_facts(rows: DataFrame, key: str, relations: Sequence[Relation]) -> DataFrame:
    """The facts of relations from the first table of `tagged_rows` to each of the others, in one aggregate."""
    known, here = F.col(key).isNotNull(), F.col("n0")

    def total(amount, test):
        return F.coalesce(F.sum(F.when(test, amount)), F.lit(0))

    counted = []
    for i, relation in enumerate(relations, 1):
        there = F.col(f"n{i}")
        counted.append(F.struct(
            F.lit(relation.source).alias("source_table"), F.lit(relation.target).alias("target_table"), F.lit(relation.key).alias("key_column"),
            F.lit(relation.cardinality).alias("cardinality"), F.coalesce(F.sum(here), F.lit(0)).alias("source_count"),
            total(here, ~known).alias("source_nulls"), total(there, ~known).alias("target_nulls"),
            total(here - 1, known & (here > 0)).alias("source_duplicates"), total(there - 1, known & (there > 0)).alias("target_duplicates"),
            F.count_if(known & (here > 0) & (there > 0)).alias("matched"), F.count_if(known & (here > 0) & (there == 0)).alias("unmatched"),
            F.count_if(known & (here == 0) & (there > 0)).alias("unreferenced")))
    return rows.agg(F.array(*counted).alias("facts")).select(F.explode("facts").alias("f")).select("f.*")


def transaction_table(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Transaction-grain star join of the related tables, and its relationship audit.

    The six tables of one row per transaction are assembled by one aggregate on their key, and those about customers by one
    on theirs; both also give the audits. Where these find no breach every count is 1, so grain and labels are those of
    the tables, and only two joins to unique keys follow. Customer profile and account columns take part in audits only.
    """
    specs = related_specs()
    if missing := sorted(set(specs) - set(tables)):
        raise ValidationError(f"Missing tables: {missing}")
    for name in specs:
        needed = [c for c in specs[name].names if c not in PERSONAL_COLUMNS]
        require_columns(tables[name], needed, name)
    by_key = {key: [r for r in RELATED_RELATIONS if r.key == key and r.source == "transaction_records"] for key in (TRANSACTION_KEY, "CustomerID")}
    columns = {name: [c for c in specs[name].names if c != TRANSACTION_KEY] for name in ("transaction_records", *(r.target for r in by_key[TRANSACTION_KEY]))}
    records = tables["transaction_records"]
    tasks = max(records.sparkSession.sparkContext.defaultParallelism, -(-records.count() // ROWS_A_TASK))
    wide = cut_lineage(tagged_rows({name: tables[name] for name in columns}, TRANSACTION_KEY, columns, tasks))
    customers = tagged_rows({name: tables[name] for name in ("transaction_records", *(r.target for r in by_key["CustomerID"]))}, "CustomerID", {"suspicious_activity": ["SuspiciousFlag"]})
    customers = cut_lineage(customers)
    merchant = next(r for r in RELATED_RELATIONS if r.key == "MerchantID")
    facts = stack([tagged_facts(wide, TRANSACTION_KEY, by_key[TRANSACTION_KEY]), tagged_facts(customers, "CustomerID", by_key["CustomerID"]),
                   relation_facts(tables[merchant.source], tables[merchant.target], merchant)])
    found = {(r.target_table, r.key_column): r for r in facts.collect()}
    ordered = [found[r.target, r.key] for r in RELATED_RELATIONS]
    if not ordered[0].source_count:
        raise ValidationError("transaction_records is empty")
    for relation, row in zip(RELATED_RELATIONS, ordered, strict=True):
        if broken := breaches(row, relation):
            raise ValidationError(f"{relation.source} -> {relation.target}: {broken}, keys such as {_keys_shown(row, relation, tables)}")
    require_target(wide, RELATED_TARGET, both_classes=False)
    audits = facts.sparkSession.createDataFrame([tuple(r) for r in ordered], facts.schema)

    out = attach(wide.where("n0 > 0"), customers.where("n0 > 0"), "CustomerID", ["SuspiciousFlag"])
    out = attach(out, tables["merchant_data"], "MerchantID", ["MerchantName", "Location"])
    out = out.select(
        TRANSACTION_KEY, "Amount", "CustomerID", "Timestamp", "MerchantID", RELATED_TARGET, "Category",
        "TransactionAmount", "AnomalyScore", "SuspiciousFlag", "MerchantName", "Location",
    )
    return out, _with_status(audits)


def related_quality_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """check_name, status, detail: columns, gaps, repeated rows, key relations and label values of the related tables."""
    specs = related_specs()
    unlike = sorted(name for name, spec in specs.items() if set(tables[name].columns) != set(spec.names))
    report = tables_report({name: tables[name] for name in specs}).where(F.col("table_name") == "all").first()
    try:
        breach = None
        transaction_table(tables)
    except ValidationError as error:
        breach = str(error)
    label = F.col(RELATED_TARGET)
    labels = tables["fraud_indicators"].agg(F.count_if(label == 0), F.count_if(label == 1), F.count_if(~F.coalesce(label.isin(0, 1), F.lit(False)))).first()
    rows = [
        ("columns", "failed" if unlike else "passed", f"tables with other columns than declared: {unlike}"),
        ("gaps", "warning" if report.missing_cells else "passed", f"cells without value: {report.missing_cells}"),
        ("repeated rows", "warning" if report.duplicate_rows else "passed", f"rows that repeat another: {report.duplicate_rows}"),
        ("relations", "failed" if breach else "passed", breach or "every key meets exactly one row"),
        ("labels", "failed" if labels[2] else "passed" if labels[0] and labels[1] else "warning", f"negative, positive, other: {tuple(labels)}"),
    ]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "check_name string, status string, detail string")

"""Declared table contracts: ordered typed columns plus row and label rules."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, file names and label domains of the supported data sets.
WIDE_FEATURES = ("Time", *(f"V{i}" for i in range(1, 29)), "Amount")
WIDE_COMPONENTS = tuple(f"V{i}" for i in range(1, 29))
WIDE_TARGET = "Class"
RELATED_TARGET = "FraudIndicator"
TRANSACTION_KEY = "TransactionID"
PERSONAL_COLUMNS = ("Name", "Address", "Age", "AccountBalance", "LastLogin")
RELATED_NUMERIC = ("Amount", "TransactionAmount", "TimestampHour", "TimestampDayOfWeek", "TimestampMonth")
RELATED_CATEGORICAL = ("Category",)
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


class Contract:
    """What a table must be before any operator accepts it: typed columns, and traits.

    The label column carries its permitted values as `labels` in its own metadata, so the schema alone tells what a label
    is. Traits: `gaps` permits missing cells, `ordered` fixes the order of the columns. rows bounds the number of rows.
    """

    def __init__(self, name: str, schema: T.StructType, *traits: str, rows: tuple[int, int | None] = (1, None)):
        if unknown := set(traits) - {"gaps", "ordered"}:
            raise ValueError(f"unknown traits {sorted(unknown)}")
        self.name, self.schema, self.traits, self.rows = name, schema, frozenset(traits), rows

    @property
    def names(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def label(self) -> T.StructField | None:
        return next((f for f in self.schema if "labels" in f.metadata), None)


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def struct_of(columns: str, label: str | None = None) -> T.StructType:
    """StructType from 'name type, name type' without needing a running session; `label` holds 0 or 1."""
    pairs = (item.split() for item in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind], metadata={"labels": [0, 1]} if name == label else {}) for name, kind in pairs])


def related_specs() -> dict[str, Contract]:
    """Contracts of the ten related tables, keyed by file stem, in load order."""
    tables = {
        "account_activity": "CustomerID long, AccountBalance double, LastLogin string",
        "customer_data": "CustomerID long, Name string, Age long, Address string",
        "fraud_indicators": "TransactionID long, FraudIndicator int",
        "suspicious_activity": "CustomerID long, SuspiciousFlag int",
        "merchant_data": "MerchantID long, MerchantName string, Location string",
        "transaction_category_labels": "TransactionID long, Category string",
        "amount_data": "TransactionID long, TransactionAmount double",
        "anomaly_scores": "TransactionID long, AnomalyScore double",
        "transaction_metadata": "TransactionID long, Timestamp string, MerchantID long",
        "transaction_records": "TransactionID long, Amount double, CustomerID long",
    }
    return {name: Contract(name, struct_of(ddl, RELATED_TARGET)) for name, ddl in tables.items()}


def wide_spec(*traits: str) -> Contract:
    """Contract of the wide, time-ordered numeric table (exact column order)."""
    return Contract("wide_transactions", struct_of(", ".join(f"{c} double" for c in WIDE_FEATURES) + ", Class int", WIDE_TARGET), "ordered", *traits)

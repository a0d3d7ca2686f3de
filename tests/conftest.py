import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.schema import WIDE_FEATURES, related_specs, wide_spec  # noqa: E402
from riskloom.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("riskloom-tests", "local[8]", **{"spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


RELATED_ROWS = {
    "account_activity": [(10, 1000.0, "2022-01-01"), (20, 2000.0, "2022-01-02"), (30, 3000.0, "2022-01-03")],
    "customer_data": [(10, "Test A", 31, "A"), (20, "Test B", 42, "B"), (30, "Test C", 53, "C")],
    "fraud_indicators": [(1, 0), (2, 1), (3, 0)],
    "suspicious_activity": [(10, 0), (20, 1), (30, 0)],
    "merchant_data": [(100, "M1", "L1"), (200, "M2", "L2"), (300, "M3", "L3")],
    "transaction_category_labels": [(1, "Food"), (2, "Travel"), (3, "Retail")],
    "amount_data": [(1, 110.0), (2, 120.0), (3, 130.0)],
    "anomaly_scores": [(1, 0.1), (2, 0.2), (3, 0.3)],
    "transaction_metadata": [(1, "2022-01-01 00:00:00", 100), (2, "2022-01-01 01:00:00", 100), (3, "2022-01-02 00:00:00", 200)],
    "transaction_records": [(1, 10.0, 10), (2, 20.0, 10), (3, 30.0, 20)],
}


def related_tables(spark, **changes):
    specs = related_specs()
    rows = RELATED_ROWS | changes
    return {name: spark.createDataFrame(rows[name], specs[name].schema) for name in specs}


def write_related_csv(folder):
    specs = related_specs()
    for i, (name, rows) in enumerate(RELATED_ROWS.items()):
        nested = folder / f"part{i % 3}"
        nested.mkdir(exist_ok=True)
        lines = [",".join(specs[name].names)] + [",".join(str(v) for v in row) for row in rows]
        (nested / f"{name}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")


def wide_frame(spark, n, row):
    """Wide table from a function r -> (time, amount, component function, label)."""
    rows = []
    for r in range(n):
        time, amount, component, label = row(r)
        rows.append((float(time), *[float(component(i)) for i in range(1, 29)], None if amount is None else float(amount), int(label)))
    return spark.createDataFrame(rows, wide_spec().schema)


def modular_toy(spark, n=400, k=4):
    return wide_frame(spark, n, lambda r: (r // 4, r % 17, lambda i: ((r * i) % 23) / (i + 1), r % k == 0))


NAMES = list(WIDE_FEATURES)

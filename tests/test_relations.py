import pytest
from conftest import RELATED_ROWS, related_tables

from riskloom.errors import ValidationError
from riskloom.operators import relations
from riskloom.operators.relations import Relation
from riskloom.schema import PERSONAL_COLUMNS

COLUMNS = ["TransactionID", "Amount", "CustomerID", "Timestamp", "MerchantID", "FraudIndicator", "Category",
           "TransactionAmount", "AnomalyScore", "SuspiciousFlag", "MerchantName", "Location"]


def test_transaction_table(spark):
    joined, audits = relations.transaction_table(related_tables(spark))
    assert joined.columns == COLUMNS and not set(joined.columns) & set(PERSONAL_COLUMNS)
    assert [(r.TransactionID, r.FraudIndicator, r.MerchantName, r.SuspiciousFlag) for r in joined.orderBy("TransactionID").collect()] == [
        (1, 0, "M1", 0), (2, 1, "M1", 0), (3, 0, "M2", 1)]
    facts = {(r.target_table): (r.matched, r.unmatched, r.unreferenced, r.status) for r in audits.collect()}
    for name in ("customer_data", "account_activity", "suspicious_activity", "merchant_data"):
        assert facts[name] == (2, 0, 1, "warning")
    for name in ("transaction_metadata", "fraud_indicators", "transaction_category_labels", "amount_data", "anomaly_scores"):
        assert facts[name] == (3, 0, 0, "passed")


@pytest.mark.parametrize("change, message", [
    ({"transaction_records": RELATED_ROWS["transaction_records"] + [(1, 10.0, 10)]}, "transaction_records repeating TransactionID': 1"),
    ({"fraud_indicators": RELATED_ROWS["fraud_indicators"] + [(1, 0)]}, "fraud_indicators repeating TransactionID': 1"),
    ({"transaction_records": [(1, 10.0, 999), (2, 20.0, 10), (3, 30.0, 20)]}, "CustomerID of transaction_records not in customer_data': 1.*999"),
    ({"transaction_metadata": [(1, "t", None), (2, "t", 100), (3, "t", 200)]}, "transaction_metadata without MerchantID': 1"),
    ({"amount_data": RELATED_ROWS["amount_data"] + [(4, 1.0)]}, "TransactionID of amount_data not in transaction_records': 1.*4"),
    ({"fraud_indicators": [(1, 0), (2, 3), (3, 0)]}, "0/1"),
])
def test_broken_relations(spark, change, message):
    with pytest.raises(ValidationError, match=message):
        relations.transaction_table(related_tables(spark, **change))


def test_missing_table(spark):
    tables = related_tables(spark)
    del tables["anomaly_scores"]
    with pytest.raises(ValidationError, match="Missing tables.*anomaly_scores"):
        relations.transaction_table(tables)


def test_examples_are_in_text_order(spark):
    source = spark.createDataFrame([(k,) for k in (1, 2, 3, 10, 11, 20, 100)], "k long")
    target = spark.createDataFrame([(2,)], "k long")
    assert [r.key for r in relations.unmatched_examples(source, target, "k").collect()] == [1, 10, 100, 11, 20]


def test_changed_targets_and_grain(spark):
    joined = spark.createDataFrame([(1, 0), (2, 1)], "id long, y int")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "id long, y int")
    assert [r.id for r in relations.changed_targets(joined, labels, "id", "y").collect()] == [1]
    relations.require_grain(joined, "id", 2)
    with pytest.raises(ValidationError, match="4 rows, 2 repeated, for 2 transactions"):
        relations.require_grain(joined.unionByName(joined), "id", 2)
    with pytest.raises(ValidationError, match="Personal"):
        relations.attach(joined, labels.withColumnRenamed("y", "Age"), "id", ["Age"])


def test_hot_key_audit(spark):
    source = spark.range(3000).selectExpr("CASE WHEN id < 1000 THEN 7 ELSE id END AS k")
    target = spark.range(7, 3100).selectExpr("id AS k")
    row = relations.relationship_audit(source, target, Relation("s", "t", "k")).first()
    assert (row.matched, row.unmatched, row.unreferenced) == (2001, 0, 1092)


def test_related_quality_checks(spark):
    status = {r.check_name: r.status for r in relations.related_quality_checks(related_tables(spark)).collect()}
    assert status == dict.fromkeys(("columns", "gaps", "repeated rows", "relations", "labels"), "passed")
    broken = related_tables(spark, amount_data=RELATED_ROWS["amount_data"] + [(4, 1.0)])
    assert {r.check_name: r.status for r in relations.related_quality_checks(broken).collect()}["relations"] == "failed"


def test_dealt_rows_equal_combined_ones(spark):
    tables = related_tables(spark, transaction_records=[(1, 10.0, 10), (1, 20.0, 10), (None, 30.0, 20), (None, 40.0, 20), (5, 1.0, 10)])
    tables = {name: tables[name] for name in ("transaction_records", "fraud_indicators")}
    columns = {"transaction_records": ["Amount"], "fraud_indicators": ["FraudIndicator"]}
    facts = [relations.Relation("transaction_records", "fraud_indicators", "TransactionID", one_to_one=True)]
    plain, dealt = (relations.tagged_rows(tables, "TransactionID", columns, tasks) for tasks in (None, 5))
    known = "TransactionID IS NOT NULL"
    assert sorted(map(tuple, plain.where(known).collect())) == sorted(map(tuple, dealt.where(known).collect()))
    assert plain.columns == dealt.columns and plain.where(f"NOT {known}").first().n0 == 2
    assert [tuple(r) for r in relations.tagged_facts(plain, "TransactionID", facts).collect()] == [tuple(r) for r in relations.tagged_facts(dealt, "TransactionID", facts).collect()]


def test_tasks_of_the_star_follow_its_rows(spark, monkeypatch):
    seen = []
    tagged = relations.tagged_rows
    monkeypatch.setattr(relations, "ROWS_A_TASK", 1, raising=False)
    monkeypatch.setattr(relations, "tagged_rows", lambda *given: seen.append(tagged(*given)) or seen[-1])
    tables = related_tables(spark)
    rows = [(i, float(i), 10) for i in range(1, 41)]
    more = {name: [(i, *related[0][1:]) for i in range(1, 41)] for name, related in RELATED_ROWS.items() if related[0][0] == 1 and name != "transaction_records"}
    tables |= {name: spark.createDataFrame(values, tables[name].schema) for name, values in (more | {"transaction_records": rows}).items()}
    assert relations.transaction_table(tables)[0].count() == 40
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    above, exchange, below = plan.partition("Exchange hashpartitioning")
    assert exchange and "hashpartitioning" not in below and "Aggregate" in above and "Aggregate" not in below  # dealt out as they are
    assert seen[0].rdd.getNumPartitions() == 40  # one row a task, whatever the session's setting

"""Quality, relation and profile queries with their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions.columns import calendar_parts
from riskloom.operators import profile, quality, relations
from riskloom.operators.relations import Relation, attach
from riskloom.plans.tables import embedding_components, events, orders, read, timed_events
from riskloom.session import cut_lineage, shared_folder
from riskloom.sources import csv

LONG_TEXT = {"documents": ("text",)}


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    names = ("events", "orders", "lineitem", "documents")
    return quality.tables_report({n: read(spark, folder, n) for n in names}, LONG_TEXT)


def _table_sql(name: str, columns: str, numeric: str = "") -> str:
    doubles = set(numeric.split())
    missing = " + ".join(
        f"count(*) FILTER (WHERE {c} IS NULL{f' OR isnan({c})' if c in doubles else ''})" for c in columns.split())
    return (f"SELECT '{name}' AS table_name, count(*) AS row_count, CAST({len(columns.split())} AS BIGINT) AS column_count, "
            f"{missing} AS missing_cells, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name})) AS duplicate_rows "
            f"FROM {name}")


EVENT_COLUMNS = "event_id ts user_id event_type value props"
ORDER_COLUMNS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"
LINE_COLUMNS = ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                "l_returnflag l_linestatus l_shipdate")
QUALITY_REPORT_SQL = f"""
WITH each AS (
  {_table_sql('events', EVENT_COLUMNS, 'value')}
  UNION ALL {_table_sql('orders', ORDER_COLUMNS, 'o_totalprice')}
  UNION ALL {_table_sql('lineitem', LINE_COLUMNS, 'l_quantity l_extendedprice l_discount l_tax')}
  UNION ALL {_table_sql('documents', 'doc_id text lang source n_chars')})
SELECT * FROM each
UNION ALL
SELECT 'all', CAST(sum(row_count) AS BIGINT), CAST(sum(column_count) AS BIGINT),
       CAST(sum(missing_cells) AS BIGINT), CAST(sum(duplicate_rows) AS BIGINT) FROM each
"""


def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    parts = {
        "documents": quality.duplicate_rows(read(spark, folder, "documents").select("text", "lang", "source"), ("text",)),
        "lineitem_keys": quality.duplicate_rows(read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")),
        "event_types": quality.duplicate_rows(read(spark, folder, "events").select("user_id", "event_type")),
    }
    return quality.stack([df.select(F.lit(n).alias("table_name"), "*") for n, df in parts.items()])


DUPLICATE_ROWS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS table_name, CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, "
    f"CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT {cols}, count(*) AS n FROM {table} GROUP BY {cols})"
    for name, table, cols in (
        ("documents", "documents", "text, lang, source"),
        ("lineitem_keys", "lineitem", "l_orderkey, l_linenumber"),
        ("event_types", "events", "user_id, event_type"),
    ))


def target_domain(spark: SparkSession, folder: str) -> DataFrame:
    labels, vectors = read(spark, folder, "labels"), read(spark, folder, "embeddings")
    parts = {"quality": (labels, "quality"), "toxic": (labels, "toxic"), "label": (vectors, "label")}
    return quality.stack([
        quality.target_distribution(df, c).select(F.lit(n).alias("target"), "*") for n, (df, c) in parts.items()])


TARGET_DOMAIN_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS target, {c} AS label, count(*) AS row_count, coalesce({c} IN (0, 1), false) AS is_valid "
    f"FROM {t} GROUP BY {c}" for c, t in (("quality", "labels"), ("toxic", "labels"), ("label", "embeddings")))


def numeric_coercion(spark: SparkSession, folder: str) -> DataFrame:
    part, order = read(spark, folder, "part"), read(spark, folder, "orders")
    return quality.numeric_coercion(
        part.select("p_type", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")),
        ["p_type", "p_size", "p_retailprice"],
    ).unionByName(quality.numeric_coercion(order.select("o_orderpriority"), ["o_orderpriority"]))


NUMERIC_COERCION_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) AS cells, count({c}) AS non_null, "
    f"count(*) FILTER (WHERE {c} IS NOT NULL AND try_cast(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL) AS non_numeric, "
    f"count(*) FILTER (WHERE isinf(try_cast(CAST({c} AS VARCHAR) AS DOUBLE))) AS infinite FROM {t}"
    for c, t in (("p_type", "part"), ("p_size", "part"), ("p_retailprice", "part"), ("o_orderpriority", "orders")))


def missing_by_column(spark: SparkSession, folder: str) -> DataFrame:
    # Order lines joined to nothing leave real gaps: orders without lines have no line count.
    counted = read(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("last_ship"), F.sum("l_quantity").alias("quantity"))
    return quality.missing_by_column(read(spark, folder, "orders").join(counted, "o_orderkey", "left"))


MISSING_BY_COLUMN_SQL = """
WITH j AS (
  SELECT o.*, c.last_ship, c.quantity FROM orders o LEFT JOIN (
    SELECT l_orderkey, max(l_shipdate) AS last_ship, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey) c
  ON o.o_orderkey = c.l_orderkey)
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing_cells FROM j"
    for c in (ORDER_COLUMNS + " last_ship quantity").split())


def quality_checks(spark: SparkSession, folder: str) -> DataFrame:
    df = timed_events(spark, folder).select("event_id", "seconds", "user_id", "event_type", "value", "y")
    return quality.quality_checks(df, "y", "seconds", "value", columns=("event_id", "seconds", "user_id", "event_type", "value", "y"))


QUALITY_CHECKS_SQL = """
WITH t AS (
  SELECT event_id, date_diff('microsecond', (SELECT min(ts) FROM events), ts) / 1e6 AS seconds, user_id, event_type, value,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events),
a AS (
  SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS d,
         count(*) FILTER (WHERE event_id IS NULL) + count(*) FILTER (WHERE seconds IS NULL) + count(*) FILTER (WHERE user_id IS NULL)
         + count(*) FILTER (WHERE event_type IS NULL) + count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS miss,
         count(*) FILTER (WHERE event_type IS NOT NULL AND try_cast(event_type AS DOUBLE) IS NULL) AS bad,
         count(*) FILTER (WHERE isinf(value)) AS inf, min(seconds) AS tmin, min(value) AS amin,
         count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM t)
SELECT 'columns' AS check_name, 'passed' AS status, 'absent or undeclared: 0' AS detail FROM a
UNION ALL SELECT 'gaps', CASE WHEN miss = 0 THEN 'passed' ELSE 'warning' END, 'cells: ' || miss FROM a
UNION ALL SELECT 'repeated rows', CASE WHEN n = d THEN 'passed' ELSE 'warning' END, 'rows: ' || (n - d) FROM a
UNION ALL SELECT 'numbers', CASE WHEN bad = 0 AND inf = 0 THEN 'passed' ELSE 'failed' END, 'unreadable: ' || bad || ', infinite: ' || inf FROM a
UNION ALL SELECT 'ranges', CASE WHEN tmin >= 0 AND amin >= 0 AND bad = 0 AND inf = 0 THEN 'passed' ELSE 'failed' END,
  'below zero: ' || concat_ws(', ', CASE WHEN tmin < 0 THEN 'seconds' END, CASE WHEN amin < 0 THEN 'value' END) FROM a
UNION ALL SELECT 'labels', CASE WHEN n > pos + neg THEN 'failed' WHEN pos > 0 AND neg > 0 THEN 'passed' ELSE 'warning' END,
  'zero: ' || neg || ', one: ' || pos || ', other: ' || (n - pos - neg) FROM a
"""


def star_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The ten related tables made of orders, customers and line items."""
    orders_of, customers, key = orders(spark, folder), read(spark, folder, "customer"), F.col("o_orderkey").alias("TransactionID")
    per_order = read(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("supplier"), F.count(F.lit(1)).alias("n"))
    # Two tables are made of it, one of which is read twice.
    rolled = cut_lineage(orders_of.join(per_order, "o_orderkey", "left").select("o_orderkey", "o_orderdate", "supplier", "n"))
    client = F.col("c_custkey").alias("CustomerID")
    return {
        "account_activity": customers.select(client, F.col("c_acctbal").alias("AccountBalance"), F.lit("").alias("LastLogin")),
        "customer_data": customers.select(client, F.col("c_name").alias("Name"), F.lit(0).cast("long").alias("Age"), F.lit("").alias("Address")),
        "fraud_indicators": orders_of.select(key, F.col("y").alias("FraudIndicator")),
        "suspicious_activity": customers.select(client, (F.col("c_acctbal") < 0).cast("int").alias("SuspiciousFlag")),
        "merchant_data": read(spark, folder, "supplier").select(F.col("s_suppkey").alias("MerchantID"), F.col("s_name").alias("MerchantName"), F.col("s_nationkey").cast("string").alias("Location")),
        "transaction_category_labels": orders_of.select(key, F.col("o_orderpriority").alias("Category")),
        "amount_data": orders_of.select(key, F.round(F.col("o_totalprice") * 2, 2).alias("TransactionAmount")),
        "anomaly_scores": rolled.select(key, F.coalesce("n", F.lit(0)).cast("double").alias("AnomalyScore")),
        "transaction_metadata": rolled.select(key, F.date_format("o_orderdate", "yyyy-MM-dd").alias("Timestamp"), F.coalesce("supplier", F.lit(1)).cast("long").alias("MerchantID")),
        "transaction_records": orders_of.select(key, F.col("o_totalprice").alias("Amount"), F.col("o_custkey").alias("CustomerID")),
    }


def related_star(spark: SparkSession, folder: str) -> DataFrame:
    """Ten audited tables joined to one row per order."""
    return relations.transaction_table(star_tables(spark, folder))[0]


_STAR_SQL = """
WITH l AS (SELECT l_orderkey, min(l_suppkey) AS supplier, count(*) AS n FROM lineitem GROUP BY 1),
t AS (
  SELECT o_orderkey AS TransactionID, o_totalprice AS Amount, o_custkey AS CustomerID, strftime(o_orderdate, '%Y-%m-%d') AS Timestamp,
    CAST(coalesce(supplier, 1) AS BIGINT) AS MerchantID, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS FraudIndicator, o_orderpriority AS Category,
    round(o_totalprice * 2, 2) AS TransactionAmount, CAST(coalesce(n, 0) AS DOUBLE) AS AnomalyScore
  FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
"""
RELATED_STAR_SQL = _STAR_SQL + """
SELECT t.*, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS SuspiciousFlag, s_name AS MerchantName, CAST(s_nationkey AS VARCHAR) AS Location
FROM t JOIN customer ON c_custkey = CustomerID JOIN supplier ON s_suppkey = MerchantID
"""


def related_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The nine audits that the star rests on."""
    return relations.transaction_table(star_tables(spark, folder))[1]


RELATED_AUDIT_SQL = _STAR_SQL + """,
one AS (SELECT unnest(['transaction_metadata', 'fraud_indicators', 'transaction_category_labels', 'amount_data', 'anomaly_scores']) AS target_table),
many AS (SELECT unnest(['customer_data', 'account_activity', 'suspicious_activity']) AS target_table)
SELECT 'transaction_records' AS source_table, target_table, 'TransactionID' AS key_column, 'one-to-one' AS cardinality,
  (SELECT count(*) FROM t) AS matched, CAST(0 AS BIGINT) AS unmatched, CAST(0 AS BIGINT) AS unreferenced, 'passed' AS status FROM one
UNION ALL SELECT 'transaction_records', target_table, 'CustomerID', 'many-to-one', (SELECT count(DISTINCT CustomerID) FROM t), 0, u,
  CASE WHEN u = 0 THEN 'passed' ELSE 'warning' END FROM many, (SELECT count(*) AS u FROM customer WHERE c_custkey NOT IN (SELECT CustomerID FROM t))
UNION ALL SELECT 'transaction_metadata', 'merchant_data', 'MerchantID', 'many-to-one', (SELECT count(DISTINCT MerchantID) FROM t), 0, u,
  CASE WHEN u = 0 THEN 'passed' ELSE 'warning' END FROM (SELECT count(*) AS u FROM supplier WHERE s_suppkey NOT IN (SELECT MerchantID FROM t))
"""


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, whose texts hold commas, quotes and line breaks, written as CSV and read back by quote parity."""
    target = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    source = read(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    source.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(target)
    cells, _, _ = csv.read_text_cells(spark, target, "documents")
    return cells.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "lang", "source")


CSV_ROUND_TRIP_SQL = "SELECT doc_id, sha256(text) AS text_sha256, lang, source FROM documents"


def value_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return quality.value_ranges(timed_events(spark, folder), ["seconds", "value"])


VALUE_RANGES_SQL = """
SELECT 'seconds' AS column_name, min(s) AS lowest, max(s) AS highest
FROM (SELECT date_diff('microsecond', (SELECT min(ts) FROM events), ts) / 1e6 AS s FROM events)
UNION ALL SELECT 'value', min(value), max(value) FROM events WHERE isfinite(value)
"""


def key_audit(spark: SparkSession, folder: str) -> DataFrame:
    keys = {"lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "labels": ["doc_id"]}
    return quality.stack([relations.key_audit(read(spark, folder, t), k, t) for t, k in keys.items()])


KEY_AUDIT_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{k}' AS key_columns, count(*) AS row_count, "
    f"count(*) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in k.split(','))}) AS null_keys, "
    f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {t})) AS duplicate_keys FROM {t}"
    for t, k in (("lineitem", "l_orderkey,l_linenumber"), ("orders", "o_orderkey"), ("customer", "c_custkey"), ("labels", "doc_id")))

RELATIONS = (
    Relation("orders", "customer", "o_custkey", target_key="c_custkey"),
    Relation("customer", "nation", "c_nationkey", target_key="n_nationkey"),
    Relation("nation", "region", "n_regionkey", target_key="r_regionkey"),
    Relation("lineitem", "orders", "l_orderkey", target_key="o_orderkey"),
    Relation("lineitem", "part", "l_partkey", target_key="p_partkey"),
    Relation("lineitem", "supplier", "l_suppkey", target_key="s_suppkey"),
    Relation("labels", "documents", "doc_id"),
)


def relationship_audit(spark: SparkSession, folder: str) -> DataFrame:
    tables = {n: read(spark, folder, n) for r in RELATIONS for n in (r.source, r.target)}
    return relations.relationships_report(tables, RELATIONS)


RELATIONSHIP_AUDIT_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{r.source.title()}' AS source_table, '{r.target.title()}' AS target_table, '{r.key}' AS key_column,
  '{r.cardinality}' AS cardinality, count(*) FILTER (WHERE s IS NOT NULL AND t IS NOT NULL) AS matched,
  count(*) FILTER (WHERE t IS NULL) AS unmatched, count(*) FILTER (WHERE s IS NULL) AS unreferenced,
  CASE WHEN count(*) FILTER (WHERE t IS NULL OR s IS NULL) = 0 THEN 'passed' ELSE 'warning' END AS status
FROM (SELECT DISTINCT {r.key} AS s FROM {r.source}) FULL OUTER JOIN
     (SELECT DISTINCT {r.target_key or r.key} AS t FROM {r.target}) ON s = t""" for r in RELATIONS)


def fk_examples(spark: SparkSession, folder: str) -> DataFrame:
    return relations.unmatched_examples(read(spark, folder, "orders"), read(spark, folder, "lineitem"), "o_orderkey", "l_orderkey")


FK_EXAMPLES_SQL = """
SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 5
"""


def transaction_table(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with customer segment, nation, region and a per-order line roll-up, one row per order.

    The chain of references is audited before any join; customer name and balance never join.
    """
    tables = {n: read(spark, folder, n) for n in ("customer", "nation", "region", "lineitem")}
    tables["orders"] = orders(spark, folder)
    relations.require_relations(tables, RELATIONS[:4])
    rollup = tables["lineitem"].groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("l_extendedprice").alias("line_amount"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned_lines"))
    out = tables["orders"].select(
        F.col("o_orderkey"), "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("order_date"), "o_orderpriority", "y")
    out = attach(out, rollup, "o_orderkey", ["line_count", "line_amount", "returned_lines"], "l_orderkey")
    out = attach(out, tables["customer"], "o_custkey", ["c_mktsegment", "c_nationkey"], "c_custkey")
    out = attach(out, tables["nation"], "c_nationkey", ["n_name", "n_regionkey"], "n_nationkey")
    out = attach(out, tables["region"], "n_regionkey", ["r_name"], "r_regionkey")
    return out.select(
        "o_orderkey", "o_custkey", "o_totalprice", "order_date", "o_orderpriority", "y", "c_mktsegment", "n_name", "r_name",
        F.coalesce("line_count", F.lit(0)).alias("line_count"), F.round("line_amount", 2).alias("line_amount"),
        F.coalesce("returned_lines", F.lit(0)).alias("returned_lines"))


TRANSACTION_TABLE_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS order_date, o_orderpriority,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, c_mktsegment, n_name, r_name,
       coalesce(line_count, 0) AS line_count, round(line_amount, 2) AS line_amount, coalesce(returned_lines, 0) AS returned_lines
FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS line_count, sum(l_extendedprice) AS line_amount,
                  count(*) FILTER (WHERE l_returnflag = 'R') AS returned_lines FROM lineitem GROUP BY l_orderkey)
  ON o_orderkey = l_orderkey
LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey
"""


def kpi_overview(spark: SparkSession, folder: str) -> DataFrame:
    df = orders(spark, folder)
    quality.overview_guard(df, "y", "o_totalprice")
    return profile.kpi_overview(df, "y", "o_totalprice").withColumns({
        "fraud_rate": F.round("fraud_rate", 6), "total_amount": F.round("total_amount", 2),
        "average_amount": F.round("average_amount", 4)})


KPI_OVERVIEW_SQL = """
SELECT count(*) AS total_transactions, count(*) FILTER (WHERE o_orderstatus = 'F') AS fraud_transactions,
       count(*) FILTER (WHERE o_orderstatus <> 'F') AS legitimate_transactions,
       round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS fraud_rate,
       round(sum(o_totalprice), 2) AS total_amount, round(avg(o_totalprice), 4) AS average_amount FROM orders
"""


def daily_trend(spark: SparkSession, folder: str) -> DataFrame:
    return profile.daily_trend(events(spark, folder), "ts", "y")


DAILY_TREND_SQL = """
SELECT CAST(ts AS DATE) AS day, count(*) AS transaction_count, count(*) FILTER (WHERE event_type = 'error') AS fraud_count
FROM events GROUP BY ALL
"""


def elapsed_trend(spark: SparkSession, folder: str) -> DataFrame:
    return profile.elapsed_trend(timed_events(spark, folder), "seconds", "y")


ELAPSED_TREND_SQL = """
SELECT bucket, count(*) AS transaction_count, count(*) FILTER (WHERE event_type = 'error') AS fraud_count,
       printf('%02d–%02d h', bucket * 2, bucket * 2 + 2) AS label
FROM (SELECT event_type, CAST(floor(date_diff('microsecond', (SELECT min(ts) FROM events), ts) / 1e6 / 7200) AS INTEGER) AS bucket
      FROM events) GROUP BY bucket
"""


def category_summary(spark: SparkSession, folder: str) -> DataFrame:
    return profile.category_summary(orders(spark, folder), "o_orderpriority", "y").withColumn("fraud_rate", F.round("fraud_rate", 6))


CATEGORY_SUMMARY_SQL = """
SELECT coalesce(o_orderpriority, 'Unknown') AS category, count(*) AS transaction_count,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS fraud_count,
       round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS fraud_rate FROM orders GROUP BY 1
"""


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def amount_by_class(spark: SparkSession, folder: str) -> DataFrame:
    both = profile.numeric_summary_by_class(orders(spark, folder), ["o_totalprice"], "y").unionByName(
        profile.numeric_summary_by_class(events(spark, folder), ["value"], "y"))
    return _rounded(both, 4, "mean", "median", "p95", "highest")


AMOUNT_BY_CLASS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CASE WHEN {test} THEN 1 ELSE 0 END AS label, count({c}) AS value_count, "
    f"round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.95), 4) AS p95, "
    f"round(max({c}), 4) AS highest FROM {t} GROUP BY 2"
    for c, t, test in (("o_totalprice", "orders", "o_orderstatus = 'F'"), ("value", "events", "event_type = 'error'")))


def component_stats(spark: SparkSession, folder: str) -> DataFrame:
    df, names = embedding_components(spark, folder)
    return _rounded(profile.component_stats(df, names, "y"), 6, "mean", "deviation", "median")


COMPONENT_STATS_SQL = """
SELECT format('c{:02d}', i - 1) AS component, y AS label, count(v) AS value_count, round(avg(v), 6) AS mean,
       round(stddev_samp(v), 6) AS deviation, round(quantile_cont(v, 0.5), 6) AS median
FROM (SELECT i, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, CAST(embedding[i] AS DOUBLE) AS v
      FROM embeddings, range(1, 65) AS r(i)) GROUP BY i, y
"""


def amount_distribution(spark: SparkSession, folder: str) -> DataFrame:
    parts = {"events": profile.amount_distribution(events(spark, folder), "value", "y"),
             "orders": profile.amount_distribution(orders(spark, folder), "o_totalprice", "y")}
    return _rounded(quality.stack([df.select(F.lit(n).alias("table_name"), "*") for n, df in parts.items()]), 6, "lower", "upper")


AMOUNT_DISTRIBUTION_SQL = "\nUNION ALL\n".join(f"""
SELECT '{t}' AS table_name, CAST(b AS INTEGER) AS bin, round(b * w, 6) AS lower,
       CASE WHEN b < 9 THEN round((b + 1) * w, 6) END AS upper,
       coalesce(legitimate, 0) AS legitimate, coalesce(fraud, 0) AS fraud
FROM range(10) AS r(b)
CROSS JOIN (SELECT quantile_cont({c}, 0.95) / 10 AS w FROM {t})
LEFT JOIN (
  SELECT CAST(list_sum(list_transform(range(1, 10), lambda i: CASE WHEN least({c}, top) >= i * (top / 10) THEN 1 ELSE 0 END)) AS INTEGER) AS k,
         count(*) FILTER (WHERE NOT {test}) AS legitimate, count(*) FILTER (WHERE {test}) AS fraud
  FROM {t}, (SELECT quantile_cont({c}, 0.95) AS top FROM {t}) GROUP BY 1) ON k = b
""" for t, c, test in (("events", "value", "event_type = 'error'"), ("orders", "o_totalprice", "o_orderstatus = 'F'")))


def density_histogram(spark: SparkSession, folder: str) -> DataFrame:
    df = events(spark, folder)
    lowest = df.agg(F.min("value")).first()[0]
    scaled = df.withColumn("scaled", F.log1p("value") if lowest >= 0 else F.col("value"))
    parts = {"raw": profile.density_histogram(df, "value", "y", 25), "scaled": profile.density_histogram(scaled, "scaled", "y", 40)}
    return _rounded(quality.stack([h.select(F.lit(n).alias("scale"), "*") for n, h in parts.items()]), 6, "lower", "density")


DENSITY_HISTOGRAM_SQL = "\nUNION ALL\n".join(f"""
SELECT '{scale}' AS scale, s.label, CAST(b AS INTEGER) AS bin, round(b * w + lo, 6) AS lower, coalesce(row_count, 0) AS row_count,
       round(coalesce(row_count, 0) / (n * w), 6) AS density
FROM (SELECT label, min(v) AS lo, (max(v) - min(v)) / {bins} AS w, count(*) AS n FROM ({source}) GROUP BY label) s
CROSS JOIN range({bins}) AS r(b)
LEFT JOIN (
  SELECT d.label, CAST(list_sum(list_transform(range(1, {bins}), lambda i: CASE WHEN v >= i * w + lo THEN 1 ELSE 0 END)) AS INTEGER) AS k,
         count(*) AS row_count
  FROM ({source}) d JOIN (SELECT label, min(v) AS lo, (max(v) - min(v)) / {bins} AS w FROM ({source}) GROUP BY label) e ON d.label = e.label
  GROUP BY ALL) c ON c.label = s.label AND k = b
""" for scale, bins, source in (
    ("raw", 25, "SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, value AS v FROM events"),
    ("scaled", 40, "SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, ln(1 + value) AS v FROM events")))


def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    df = events(spark, folder).drop("score")
    return _rounded(profile.table_profile(df, "y", "ts"), 6, "fraud_rate", "imbalance")


TABLE_PROFILE_SQL = """
WITH t AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events)
SELECT count(*) AS row_count, CAST(7 AS BIGINT) AS column_count, count(*) FILTER (WHERE y = 0) AS negatives,
       count(*) FILTER (WHERE y = 1) AS positives, round(count(*) FILTER (WHERE y = 1) / count(*), 6) AS fraud_rate,
       round(count(*) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 1), 6) AS imbalance,
       count(*) FILTER (WHERE event_id IS NULL) + count(*) FILTER (WHERE ts IS NULL) + count(*) FILTER (WHERE user_id IS NULL)
       + count(*) FILTER (WHERE event_type IS NULL) + count(*) FILTER (WHERE value IS NULL OR isnan(value))
       + count(*) FILTER (WHERE props IS NULL) AS missing_cells,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows,
       min(ts) AS time_min, max(ts) AS time_max, count(*) FILTER (WHERE ts IS NULL) AS unparsed_times FROM t
"""


def calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    parts = calendar_parts(F.col("o_orderdate"))
    return read(spark, folder, "orders").select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


CALENDAR_FEATURES_SQL = """
SELECT o_orderkey, CAST(hour(o_orderdate) AS DOUBLE) AS hour, CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS day_of_week,
       CAST(month(o_orderdate) AS DOUBLE) AS month FROM orders
"""

QUERIES = {
    "transaction_table": transaction_table, "quality_report": quality_report, "duplicate_rows": duplicate_rows,
    "target_domain": target_domain, "numeric_coercion": numeric_coercion, "missing_by_column": missing_by_column,
    "quality_checks": quality_checks, "csv_round_trip": csv_round_trip, "related_star": related_star, "related_audit": related_audit, "value_ranges": value_ranges, "key_audit": key_audit,
    "relationship_audit": relationship_audit, "fk_examples": fk_examples, "kpi_overview": kpi_overview,
    "daily_trend": daily_trend, "elapsed_trend": elapsed_trend, "category_summary": category_summary,
    "amount_by_class": amount_by_class, "component_stats": component_stats, "amount_distribution": amount_distribution,
    "density_histogram": density_histogram, "profile": table_profile, "calendar_features": calendar_features,
}
ORACLES = {
    "transaction_table": TRANSACTION_TABLE_SQL, "quality_report": QUALITY_REPORT_SQL, "duplicate_rows": DUPLICATE_ROWS_SQL,
    "target_domain": TARGET_DOMAIN_SQL, "numeric_coercion": NUMERIC_COERCION_SQL, "missing_by_column": MISSING_BY_COLUMN_SQL,
    "quality_checks": QUALITY_CHECKS_SQL, "csv_round_trip": CSV_ROUND_TRIP_SQL, "related_star": RELATED_STAR_SQL, "related_audit": RELATED_AUDIT_SQL, "value_ranges": VALUE_RANGES_SQL, "key_audit": KEY_AUDIT_SQL,
    "relationship_audit": RELATIONSHIP_AUDIT_SQL, "fk_examples": FK_EXAMPLES_SQL, "kpi_overview": KPI_OVERVIEW_SQL,
    "daily_trend": DAILY_TREND_SQL, "elapsed_trend": ELAPSED_TREND_SQL, "category_summary": CATEGORY_SUMMARY_SQL,
    "amount_by_class": AMOUNT_BY_CLASS_SQL, "component_stats": COMPONENT_STATS_SQL, "amount_distribution": AMOUNT_DISTRIBUTION_SQL,
    "density_histogram": DENSITY_HISTOGRAM_SQL, "profile": TABLE_PROFILE_SQL, "calendar_features": CALENDAR_FEATURES_SQL,
}

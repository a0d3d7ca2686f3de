"""Split, feature and metric queries with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions.columns import calendar_parts, epoch_seconds
from riskloom.operators import categories, features, metrics, split
from riskloom.plans.tables import events, orders

SEED = 42


def _dated_orders(spark: SparkSession, folder: str) -> DataFrame:
    return orders(spark, folder).withColumn("order_time", epoch_seconds("o_orderdate"))


def chrono_split(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = split.chronological_split(_dated_orders(spark, folder), "order_time", "y")
    return out.select("o_orderkey", "split")


CUTS_SQL = """
n AS (SELECT count(*) AS n FROM orders),
ends AS (SELECT t, CAST(sum(c) OVER (ORDER BY t) AS BIGINT) AS e
         FROM (SELECT o_orderdate AS t, count(*) AS c FROM orders GROUP BY 1)),
cut1 AS (SELECT t, e FROM ends, n WHERE e BETWEEN 1 AND n - 2 ORDER BY abs(e - round_even(n * 0.70, 0)), e LIMIT 1),
cut2 AS (SELECT ends.t, ends.e FROM ends, n, cut1 WHERE ends.e BETWEEN cut1.e + 1 AND n - 1
         ORDER BY abs(ends.e - round_even(n * 0.85, 0)), ends.e LIMIT 1),
chrono AS (SELECT o.*, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
                  CASE WHEN o_orderdate <= cut1.t THEN 'train' WHEN o_orderdate <= cut2.t THEN 'validation' ELSE 'test' END AS split
           FROM orders o, cut1, cut2)
"""
CHRONO_SPLIT_SQL = f"WITH {CUTS_SQL} SELECT o_orderkey, split FROM chrono"


def split_report(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = split.chronological_split(_dated_orders(spark, folder), "order_time", "y")
    return split.split_report(out, "y")


SPLIT_REPORT_SQL = f"""WITH {CUTS_SQL}
SELECT split, count(*) AS row_count, count(*) FILTER (WHERE y = 0) AS negatives, count(*) FILTER (WHERE y = 1) AS positives
FROM chrono GROUP BY split"""


def class_weight(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = split.chronological_split(_dated_orders(spark, folder), "order_time", "y")
    return out.where(F.col("split") == "train").agg(
        F.round(F.count_if(F.col("y") == 0) / F.count_if(F.col("y") == 1), 6).alias("positive_weight"))


CLASS_WEIGHT_SQL = f"""WITH {CUTS_SQL}
SELECT round(count(*) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 1), 6) AS positive_weight FROM chrono WHERE split = 'train'"""


def monotone_check(spark: SparkSession, folder: str) -> DataFrame:
    in_order = split.order_violations(events(spark, folder).withColumn("t", epoch_seconds("ts")), "event_id", "t")
    shuffled = split.order_violations(_dated_orders(spark, folder), "o_orderkey", "order_time")
    return in_order.select(F.lit("events").alias("table_name"), "*").unionByName(
        shuffled.select(F.lit("orders").alias("table_name"), "*"))


MONOTONE_CHECK_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) FILTER (WHERE v < before) AS violations "
    f"FROM (SELECT {c} AS v, lag({c}) OVER (ORDER BY {k}) AS before FROM {t})"
    for t, c, k in (("events", "ts", "event_id"), ("orders", "o_orderdate", "o_orderkey")))


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.stratified_split(orders(spark, folder), "o_orderkey", "y", SEED).select("o_orderkey", "y", "split")


STRATIFIED_SPLIT_SQL = f"""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders),
size AS (SELECT count(*) AS n, CAST(ceil(count(*) * 0.30) AS BIGINT) AS h FROM t),
c AS (SELECT y, count(*) AS k FROM t GROUP BY y),
q AS (SELECT y, k, CAST(floor(k * (n - h) / n) AS BIGINT) AS base, k * (n - h) / n - floor(k * (n - h) / n) AS rest,
             n, h FROM c, size),
tr AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= (n - h) - sum(base) OVER () THEN 1 ELSE 0 END AS n_train FROM q),
v0 AS (SELECT *, k - n_train AS r, h - CAST(ceil(h / 2) AS BIGINT) AS nv FROM tr),
v1 AS (SELECT *, CAST(floor(r * nv / h) AS BIGINT) AS vb, r * nv / h - floor(r * nv / h) AS vr FROM v0),
v2 AS (SELECT *, vb + CASE WHEN row_number() OVER (ORDER BY vr DESC, y) <= nv - sum(vb) OVER () THEN 1 ELSE 0 END AS n_val FROM v1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-{SEED}')) AS place FROM t)
SELECT o_orderkey, ranked.y, CASE WHEN place <= n_train THEN 'train' WHEN place <= n_train + n_val THEN 'validation' ELSE 'test' END AS split
FROM ranked JOIN v2 ON ranked.y = v2.y
"""


def _gapped_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with calendar parts, and price and priority blanked on every 17th order."""
    gap = F.col("o_orderkey") % 17 == 0
    parts = calendar_parts(F.col("o_orderdate"))
    return _dated_orders(spark, folder).select(
        "o_orderkey", "order_time", "y",
        F.when(~gap, F.col("o_totalprice")).alias("price"), parts["day_of_week"].alias("weekday"), parts["month"].alias("month"),
        F.when(~gap, F.regexp_replace("o_orderpriority", "[^A-Z0-9]", "_")).alias("priority"))


PRIORITIES = ("1_URGENT", "2_HIGH", "3_MEDIUM", "4_NOT_SPECIFIED", "5_LOW")


def impute_scale_onehot(spark: SparkSession, folder: str) -> DataFrame:
    parts, _ = split.chronological_split(_gapped_orders(spark, folder), "order_time", "y")
    state = features.fit_features(parts.where(F.col("split") == "train"), ["price", "weekday", "month"], ["priority"])
    out = features.transform_features(parts, state, ["o_orderkey", "split"])
    return out.withColumns({c: F.round(c, 5) for c in ("price", "weekday", "month")})


IMPUTE_SCALE_ONEHOT_SQL = f"""WITH {CUTS_SQL},
f AS (SELECT o_orderkey, split, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS price,
             CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS weekday, CAST(month(o_orderdate) AS DOUBLE) AS month,
             CASE WHEN o_orderkey % 17 <> 0 THEN regexp_replace(o_orderpriority, '[^A-Z0-9]', '_', 'g') END AS priority FROM chrono),
fill AS (SELECT quantile_cont(price, 0.5) AS med FROM f WHERE split = 'train'),
mode AS (SELECT priority AS top FROM f WHERE split = 'train' AND priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
g AS (SELECT o_orderkey, split, coalesce(price, med) AS price, weekday, month, coalesce(priority, top) AS priority FROM f, fill, mode),
s AS (SELECT avg(price) AS pm, stddev_pop(price) AS ps, avg(weekday) AS wm, stddev_pop(weekday) AS ws, avg(month) AS mm,
             stddev_pop(month) AS ms FROM g WHERE split = 'train')
SELECT o_orderkey, split, round((price - pm) / ps, 5) AS price, round((weekday - wm) / ws, 5) AS weekday,
       round((month - mm) / ms, 5) AS month,
       {', '.join(f"CAST(priority = '{p}' AS DOUBLE) AS priority_{p}" for p in PRIORITIES)} FROM g, s
"""


def open_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of all orders as a sparse category fitted on the training part; later customers have no cell."""
    parts, _ = split.chronological_split(_dated_orders(spark, folder), "order_time", "y")
    table = categories.fit_categories(parts.where(F.col("split") == "train"), "o_custkey")
    out = table.encode(parts, "customer")
    return out.select("o_orderkey", F.col("customer.size").cast("long").alias("size"), F.get("customer.indices", F.lit(0)).cast("long").alias("position"),
                      F.aggregate("customer.values", F.lit(0.0), lambda a, v: a + v).alias("total"))


OPEN_CATEGORIES_SQL = f"""WITH {CUTS_SQL},
v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS position, count(*) OVER () AS size
      FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS value FROM chrono WHERE split = 'train'))
SELECT o_orderkey, (SELECT max(size) FROM v) AS size, position, CASE WHEN position IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS total
FROM chrono LEFT JOIN v ON v.value = CAST(o_custkey AS VARCHAR)
"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        F.date_format("ts", "EEE").alias("weekday"), "y", "score", (F.col("score") >= 0.5).cast("int").alias("alert"))


_SCORED_SQL = """
t AS (SELECT strftime(ts, '%a') AS weekday, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
             least(floor(value / 5) / 100, 1.0) AS score FROM events)
"""


def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.confusion_metrics(_scored(spark, folder), "y", "alert", ["weekday"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "prevalence", "alert_rate")})


CONFUSION_METRICS_SQL = f"""WITH {_SCORED_SQL},
c AS (SELECT weekday, count(*) AS n, count(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp,
             count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp FROM t GROUP BY 1)
SELECT weekday, n AS row_count, tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive,
       tp + fp AS predicted_positive, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
       round((tp + fn) / n, 6) AS prevalence, round((tp + fp) / n, 6) AS alert_rate FROM c
"""


def ranking_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.ranking_metrics(_scored(spark, folder), "y", "score", ["weekday"])
    return out.withColumns({c: F.round(c, 6) for c in ("roc_auc", "pr_auc")})


_STEPS_SQL = """
d AS (SELECT weekday, score, sum(y) AS pos, sum(1 - y) AS neg FROM t GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY weekday) AS ap,
             sum(neg) OVER (PARTITION BY weekday) AS an FROM d WINDOW w AS (PARTITION BY weekday ORDER BY score DESC))
"""


def _ranking_sql(*values: str) -> str:
    return f"WITH {_SCORED_SQL}, {_STEPS_SQL} SELECT weekday, {', '.join(values)} FROM r GROUP BY weekday"


_AUC = "round(sum(neg * (cp - pos / 2.0)) / max(ap * an), 6) AS roc_auc"
_AP = "round(sum(pos * cp / (cp + cn)) / max(ap), 6) AS pr_auc"
RANKING_METRICS_SQL = _ranking_sql(_AUC, _AP)


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return ranking_metrics(spark, folder).drop("pr_auc")


def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return ranking_metrics(spark, folder).drop("roc_auc")


def evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Two rival scores of the events, each evaluated per weekday as its own partition."""
    base = _scored(spark, folder).select("weekday", "y", "score")
    rival = base.withColumn("score", 1 - F.col("score"))
    both = base.withColumn("model_name", F.lit("amount")).unionByName(rival.withColumn("model_name", F.lit("inverse")))
    both = both.withColumns({"alert": (F.col("score") >= 0.5).cast("int"), "split": F.col("weekday")}).drop("weekday")
    out = metrics.evaluate_models(both, "y", "score", "alert")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "prevalence", "alert_rate", "roc_auc", "pr_auc")})


EVALUATION_SQL = f"""WITH {_SCORED_SQL},
m AS (SELECT 'amount' AS model_name, weekday AS split, y, score FROM t UNION ALL SELECT 'inverse', weekday, y, 1 - score FROM t),
c AS (SELECT model_name, split, count(*) AS n, count(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp,
             count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp FROM m GROUP BY ALL),
d AS (SELECT model_name, split, score, sum(y) AS pos, sum(1 - y) AS neg FROM m GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model_name, split) AS ap,
             sum(neg) OVER (PARTITION BY model_name, split) AS an FROM d WINDOW w AS (PARTITION BY model_name, split ORDER BY score DESC)),
k AS (SELECT model_name, split, round(sum(neg * (cp - pos / 2.0)) / max(ap * an), 6) AS roc_auc,
             round(sum(pos * cp / (cp + cn)) / max(ap), 6) AS pr_auc FROM r GROUP BY ALL)
SELECT c.model_name, c.split, n AS row_count, tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive,
       tp + fp AS predicted_positive, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
       round((tp + fn) / n, 6) AS prevalence, round((tp + fp) / n, 6) AS alert_rate, roc_auc, pr_auc
FROM c JOIN k ON c.model_name = k.model_name AND c.split = k.split
"""


def _whole(spark: SparkSession, folder: str) -> DataFrame:
    """A fine score, so that curves have one point per distinct amount."""
    return events(spark, folder).select("y", (F.col("value") / 500).alias("score"))


_WHOLE_SQL = """
t AS (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, value / 500 AS score FROM events),
d AS (SELECT score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM t GROUP BY 1),
r AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, row_number() OVER w AS place, lead(pos) OVER w AS np,
             lead(neg) OVER w AS nn, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM d WINDOW w AS (ORDER BY score DESC))
"""


def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.roc_curve(_whole(spark, folder), "y", "score").select(
        "place", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


ROC_CURVE_SQL = f"""WITH {_WHOLE_SQL}
SELECT 0 AS place, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT place, round(cn / an, 6), round(cp / ap, 6) FROM r WHERE place = 1 OR np IS NULL OR np <> pos OR nn <> neg
"""


def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.pr_curve(_whole(spark, folder), "y", "score").select(
        "place", F.round("threshold", 6).alias("threshold"), F.round("precision", 6).alias("precision"),
        F.round("recall", 6).alias("recall"))


PR_CURVE_SQL = f"""WITH {_WHOLE_SQL}
SELECT CAST(0 AS BIGINT) AS place, CAST(NULL AS DOUBLE) AS threshold, CAST(1 AS DOUBLE) AS precision, CAST(0 AS DOUBLE) AS recall
UNION ALL
SELECT place, round(score, 6), round(cp / (cp + cn), 6), round(cp / ap, 6) FROM r
"""
ROC_CURVE_SQL = ROC_CURVE_SQL.replace("SELECT 0 AS place, 0.0 AS fpr, 0.0 AS tpr",
                                      "SELECT CAST(0 AS BIGINT) AS place, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr")

QUERIES = {
    "chrono_split": chrono_split, "split_report": split_report, "class_weight": class_weight, "monotone_check": monotone_check,
    "stratified_split": stratified_split, "impute_scale_onehot": impute_scale_onehot, "confusion_metrics": confusion_metrics,
    "roc_auc": roc_auc, "average_precision": average_precision, "roc_curve": roc_curve, "pr_curve": pr_curve,
    "evaluation": evaluation, "open_categories": open_categories,
}
ORACLES = {
    "chrono_split": CHRONO_SPLIT_SQL, "split_report": SPLIT_REPORT_SQL, "class_weight": CLASS_WEIGHT_SQL,
    "monotone_check": MONOTONE_CHECK_SQL, "stratified_split": STRATIFIED_SPLIT_SQL,
    "impute_scale_onehot": IMPUTE_SCALE_ONEHOT_SQL, "confusion_metrics": CONFUSION_METRICS_SQL,
    "roc_auc": _ranking_sql(_AUC), "average_precision": _ranking_sql(_AP), "roc_curve": ROC_CURVE_SQL, "pr_curve": PR_CURVE_SQL,
    "evaluation": EVALUATION_SQL, "open_categories": OPEN_CATEGORIES_SQL,
}

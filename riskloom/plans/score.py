"""Scoring, model, explanation and investigation queries with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions.columns import calendar_parts, epoch_seconds, is_alert, risk_level
from riskloom.operators import evaluate, explain, iforest, investigate, metrics, models, payload, percentiles, scoring, split
from riskloom.operators.features import FeatureState, fit_features, transform_features
from riskloom.operators.ranks import bottom_by_digest
from riskloom.plans.tables import events, lines, orders, read, spread
from riskloom.session import cut_lineage

SEED = 42


def risk_bands(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).withColumn("risk_score", F.col("score") * 100.0).select(
        "event_id", F.round("risk_score", 6).alias("risk_score"), risk_level("risk_score").alias("risk_level"),
        is_alert("score", 0.5).alias("model_alert"))


RISK_BANDS_SQL = """
SELECT event_id, round(s * 100, 6) AS risk_score,
       CASE WHEN s * 100.0 < 30 THEN 'low' WHEN s * 100.0 < 70 THEN 'medium' ELSE 'high' END AS risk_level, s >= 0.5 AS model_alert
FROM (SELECT event_id, least(floor(value / 5) / 100, 1.0) AS s FROM events)
"""


def anomaly_percentile(spark: SparkSession, folder: str) -> DataFrame:
    df = events(spark, folder)
    new = df.where(F.coalesce(F.col("event_type") != "view", F.lit(True))).select("event_id", "value")
    reference = df.where(F.col("event_type") == "view").select("value")
    return scoring.anomaly_percentile(new, reference, "value").withColumn("percentile", F.round("percentile", 6))


ANOMALY_PERCENTILE_SQL = """
SELECT event_id, value, round(refs / total * 100, 6) AS percentile FROM (
  SELECT event_id, event_type, value, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (ORDER BY value RANGE UNBOUNDED PRECEDING) AS refs,
         sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER () AS total
  FROM events) WHERE event_type IS DISTINCT FROM 'view'
"""


def percentile_index(spark: SparkSession, folder: str) -> DataFrame:
    """The same ranks from a stored index of the reference, as streams and explanations use it."""
    df = events(spark, folder)
    index = percentiles.build_index(df.where(F.col("event_type") == "view").select("value"), "value")
    new = df.where(F.coalesce(F.col("event_type") != "view", F.lit(True))).select("event_id", "value")
    return index.percentiles(new, "value").withColumn("percentile", F.round("percentile", 6))


def background_sample(spark: SparkSession, folder: str) -> DataFrame:
    return explain.background_sample(read(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, SEED)


BACKGROUND_SAMPLE_SQL = f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-{SEED}') LIMIT 100
"""


def top_contributors(spark: SparkSession, folder: str) -> DataFrame:
    df = read(spark, folder, "lineitem")
    middle = df.agg(F.avg("l_extendedprice")).first()[0]
    ranked = explain.top_contributors(
        df.select("l_orderkey", "l_extendedprice"), "l_orderkey", F.col("l_extendedprice") - F.lit(middle), ["l_extendedprice"])
    return ranked.withColumn("place", F.col("place").cast("long"))


TOP_CONTRIBUTORS_SQL = """
SELECT l_orderkey, l_extendedprice, place FROM (
  SELECT l_orderkey, l_extendedprice, row_number() OVER (
    PARTITION BY l_orderkey ORDER BY abs(l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) DESC, l_extendedprice) AS place
  FROM lineitem) WHERE place <= 5
"""

# A linear 0-100 score over four order features, for the closed-form check.
LINEAR = {"price": 0.0001, "weekday": 2.0, "month": -1.5, "day": 0.25}
LINEAR_BACKGROUND = 8


def _order_features(spark: SparkSession, folder: str) -> DataFrame:
    parts = calendar_parts(F.col("o_orderdate"))
    return read(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price"), parts["day_of_week"].alias("weekday"), parts["month"].alias("month"),
        F.dayofmonth("o_orderdate").cast("double").alias("day"))


def shapley_linear(spark: SparkSession, folder: str) -> DataFrame:
    cases = _order_features(spark, folder)
    names = list(LINEAR)
    background = explain.background_rows(bottom_by_digest(cases, "o_orderkey", LINEAR_BACKGROUND, SEED), names)

    def score_rows(df: DataFrame) -> DataFrame:
        return df.withColumn("score", sum((F.col("x")[i] * LINEAR[n] for i, n in enumerate(names)), F.lit(20.0)))

    out = explain.shapley_values(cases, "o_orderkey", names, background, score_rows, max_evals=27, seed=SEED)
    return out.select("o_orderkey", F.round("score", 6).alias("score"), F.round("baseline_score", 6).alias("baseline_score"),
                      *[(F.round(F.col("shap")[i], 6) + 0.0).alias(f"phi_{n}") for i, n in enumerate(names)], "additive")


SHAPLEY_LINEAR_SQL = f"""
WITH f AS (SELECT o_orderkey, o_totalprice AS price, CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS weekday,
                  CAST(month(o_orderdate) AS DOUBLE) AS month, CAST(day(o_orderdate) AS DOUBLE) AS day FROM orders),
b AS (SELECT avg(price) AS price, avg(weekday) AS weekday, avg(month) AS month, avg(day) AS day FROM (
  SELECT * FROM f ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-{SEED}') LIMIT {LINEAR_BACKGROUND}))
SELECT o_orderkey, round({' + '.join(f'f.{n} * {c}::DOUBLE' for n, c in LINEAR.items())} + 20, 6) AS score,
       round({' + '.join(f'b.{n} * {c}::DOUBLE' for n, c in LINEAR.items())} + 20, 6) AS baseline_score,
       {', '.join(f"round((f.{n} - b.{n}) * {c}::DOUBLE, 6) + 0.0 AS phi_{n}" for n, c in LINEAR.items())},
       true AS additive
FROM f, b
"""

_PAYLOAD_SQL = """CASE
  WHEN o_orderpriority = '1-URGENT' THEN concat('{"Time": ', o_custkey, ', "Amount": ', CAST(floor(o_totalprice) AS BIGINT), '}')
  WHEN o_orderpriority = '2-HIGH' THEN concat('{"Time": ', o_custkey, ', "Amount": "', CAST(floor(o_totalprice) AS BIGINT), '"}')
  WHEN o_orderpriority = '3-MEDIUM' THEN concat('{"Amount": ', CAST(floor(o_totalprice) AS BIGINT), '}')
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN concat('{"Time": 0, "Amount": ', CAST(floor(o_totalprice) AS BIGINT), ', "Class": 1}')
  WHEN o_orderstatus = 'P' THEN concat('Time=', o_custkey)
  ELSE concat('{"Time": ', o_custkey, ', "Amount": ', CAST(-floor(o_totalprice) AS BIGINT), '}') END"""


def strict_payload(spark: SparkSession, folder: str) -> DataFrame:
    df = spread(read(spark, folder, "orders")).select("o_orderkey", F.expr(_PAYLOAD_SQL).alias("body"))
    out = payload.parse_payloads(df, "body", ["Time", "Amount"])
    return out.select("o_orderkey", "reject_reason", F.col("Time").alias("time"), F.col("Amount").alias("amount"))


STRICT_PAYLOAD_SQL = f"""
WITH p AS (SELECT o_orderkey, {_PAYLOAD_SQL} AS body FROM orders),
k AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS j FROM p),
r AS (SELECT *, CASE
  WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'payload must be a JSON object'
  WHEN NOT list_has_all(json_keys(j), ['Time', 'Amount']) THEN
    'missing required features: ' || array_to_string(list_sort(list_filter(['Time', 'Amount'], lambda n: NOT list_contains(json_keys(j), n))), ', ')
  WHEN len(json_keys(j)) > 2 THEN CAST(len(json_keys(j)) - 2 AS VARCHAR) || ' unsupported field(s)'
  WHEN json_type(j, '$.Time') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'feature Time must be a numeric value'
  WHEN CAST(json_extract_string(j, '$.Time') AS DOUBLE) < 0 THEN 'feature Time cannot be negative'
  WHEN json_type(j, '$.Amount') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'feature Amount must be a numeric value'
  WHEN CAST(json_extract_string(j, '$.Amount') AS DOUBLE) < 0 THEN 'feature Amount cannot be negative' END AS reject_reason FROM k)
SELECT o_orderkey, reject_reason, CASE WHEN reject_reason IS NULL THEN CAST(json_extract_string(j, '$.Time') AS DOUBLE) END AS time,
       CASE WHEN reject_reason IS NULL THEN CAST(json_extract_string(j, '$.Amount') AS DOUBLE) END AS amount FROM r
"""

def typed_payload(spark: SparkSession, folder: str) -> DataFrame:
    df = read(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("Time"), (F.col("l_extendedprice") - 40000).alias("Amount"),
        F.try_divide(F.col("l_tax"), F.col("l_discount")).alias("V1"), F.log(F.col("l_discount")).alias("V2"))
    reason = payload.typed_reason(df, ["Time", "V1", "V2", "Amount"])
    return df.withColumn("reject_reason", reason).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("row_count"))


TYPED_PAYLOAD_SQL = """
SELECT CASE WHEN l_quantity IS NULL THEN 'feature Time must be a numeric value' WHEN l_quantity < 0 THEN 'feature Time cannot be negative'
            WHEN l_discount = 0 THEN 'feature V1 must be a numeric value'
            WHEN l_extendedprice - 40000 < 0 THEN 'feature Amount cannot be negative' END AS reject_reason, count(*) AS row_count
FROM lineitem GROUP BY 1
"""

_ID_SQL = """CASE WHEN o_orderstatus = 'F' THEN concat('  case-', o_orderkey, ' ')
  WHEN o_orderpriority = '1-URGENT' THEN '   ' WHEN o_orderpriority = '5-LOW' THEN repeat('x', CAST(o_orderkey % 200 AS INTEGER))
  ELSE CAST(o_orderkey AS {text}) END"""


def case_ids(spark: SparkSession, folder: str) -> DataFrame:
    df = read(spark, folder, "orders").select("o_orderkey", F.expr(_ID_SQL.format(text="STRING")).alias("given"))
    return payload.case_ids(df, "given").select("o_orderkey", "case_id")


CASE_IDS_SQL = f"""
SELECT o_orderkey, CASE WHEN length(trim(g)) BETWEEN 1 AND 128 THEN trim(g) END AS case_id
FROM (SELECT o_orderkey, {_ID_SQL.format(text='VARCHAR')} AS g FROM orders)
"""

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _prepared_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, FeatureState]:
    df = lines(spark, folder).withColumn("ship_time", epoch_seconds("l_shipdate")).select("ship_time", "y", *LINE_FEATURES)
    parts, _ = split.chronological_split(df, "ship_time", "y")
    return parts, fit_features(parts.where(F.col("split") == "train"), LINE_FEATURES)


def _evaluated(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Fit on the training part, score validation and test once, and report every metric."""
    parts, state = _prepared_lines(spark, folder)
    model = models.FITTERS[name](models.training_rows(parts, state, "y"))
    scorer = scoring.ProbabilityScorer(name, model, state)
    scored = scoring.score_batch(parts.where(F.col("split") != "train"), scorer, ["split", "y"])
    # Every metric reads the scores, so the model's output is stored once.
    scored = cut_lineage(scored.select("model_name", "split", "y", "raw_score", "model_alert"))
    return metrics.evaluate_models(scored, "y", "raw_score", "model_alert")


def logistic(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluated(spark, folder, "logistic_regression")


def random_forest(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluated(spark, folder, "random_forest")


def gbt(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluated(spark, folder, "gradient_boosting")


ORDER_FEATURES = ["price", "line_count", "line_amount"]


def prepared_orders(spark: SparkSession, folder: str) -> tuple[DataFrame, FeatureState]:
    """Orders with a line roll-up; orders without lines have gaps that the fitted state fills."""
    rollup = read(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("line_count"), F.sum("l_extendedprice").alias("line_amount"))
    df = orders(spark, folder).join(rollup, "o_orderkey", "left").select(
        "o_orderkey", "y", epoch_seconds("o_orderdate").alias("order_time"), F.col("o_totalprice").alias("price"),
        "line_count", F.round("line_amount", 2).alias("line_amount"))
    df = spread(cut_lineage(df))  # the join feeds cuts, fits, references and scores
    parts, _ = split.chronological_split(df, "order_time", "y")
    return parts, fit_features(parts.where(F.col("split") == "train"), ORDER_FEATURES)


def isolation_forest(spark: SparkSession, folder: str) -> DataFrame:
    parts, state = prepared_orders(spark, folder)
    train = parts.where(F.col("split") == "train")
    forest = iforest.fit_isolation_forest(transform_features(train, state, ["o_orderkey"]), "o_orderkey", state.names, seed=SEED)
    scorer = scoring.AnomalyScorer("isolation_forest", forest, state, scoring.training_reference(forest, train, state))
    return scoring.score_batch(parts, scorer, ["o_orderkey", "split"])


def investigation(spark: SparkSession, folder: str) -> DataFrame:
    parts, state = prepared_orders(spark, folder)
    model = models.fit_logistic(models.training_rows(parts, state, "y"))
    scorer = scoring.ProbabilityScorer("logistic_regression", model, state)
    train = transform_features(parts.where(F.col("split") == "train"), state, ["o_orderkey"])
    background = explain.background_rows(bottom_by_digest(train, "o_orderkey", explain.MAX_BACKGROUND_ROWS, SEED), state.names)
    return investigate.investigate(parts, "o_orderkey", scorer, background, time="order_time", amount="price")


def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """All three kinds of score on held-out orders, compared in one report."""
    parts, state = prepared_orders(spark, folder)
    train = parts.where(F.col("split") == "train")
    rows = models.training_rows(parts, state, "y")
    forest = iforest.fit_isolation_forest(transform_features(train, state, ["o_orderkey"]), "o_orderkey", state.names, seed=SEED)
    scorers = [
        scoring.ProbabilityScorer("logistic_regression", models.fit_logistic(rows), state),
        scoring.ProbabilityScorer("gradient_boosting", models.fit_boosting(rows), state),
        scoring.AnomalyScorer("isolation_forest", forest, state, scoring.training_reference(forest, train, state)),
    ]
    return evaluate.compare_scorers(parts, "y", scorers)[0]


QUERIES = {
    "risk_bands": risk_bands, "anomaly_percentile": anomaly_percentile, "background_sample": background_sample,
    "top_contributors": top_contributors, "shapley_linear": shapley_linear, "strict_payload": strict_payload, "case_ids": case_ids,
    "logistic": logistic, "random_forest": random_forest, "gbt": gbt, "isolation_forest": isolation_forest,
    "investigation": investigation, "typed_payload": typed_payload, "model_comparison": model_comparison, "percentile_index": percentile_index,
}
ORACLES = {
    "risk_bands": RISK_BANDS_SQL, "anomaly_percentile": ANOMALY_PERCENTILE_SQL, "background_sample": BACKGROUND_SAMPLE_SQL,
    "top_contributors": TOP_CONTRIBUTORS_SQL, "shapley_linear": SHAPLEY_LINEAR_SQL, "strict_payload": STRICT_PAYLOAD_SQL,
    "case_ids": CASE_IDS_SQL, "typed_payload": TYPED_PAYLOAD_SQL, "percentile_index": ANOMALY_PERCENTILE_SQL,
}

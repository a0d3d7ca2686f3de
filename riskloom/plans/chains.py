"""Whole chains as queries: fit to optimum, bundle and scores; streams; stored evaluations; CSV files to tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.operators import metrics, models, optimum, profile, scoring
from riskloom.operators.features import FeatureState, prepare_wide, transform_features, validate_splits
from riskloom.plans.describe import RELATED_STAR_SQL, star_tables
from riskloom.plans.learn import CUTS_SQL
from riskloom.plans.score import ORDER_FEATURES, prepared_orders
from riskloom.plans.tables import events, orders, read, spread
from riskloom.schema import WIDE_COMPONENTS, WIDE_FEATURES
from riskloom.session import shared_folder
from riskloom.sinks import bundle, tables
from riskloom.sources import csv, stored
from riskloom.streaming import flows


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- fit to the optimum, bundle, scores

def _fitted(spark: SparkSession, folder: str) -> tuple[DataFrame, FeatureState, models.Training, optimum.LogisticModel, optimum.Certificate, float]:
    parts, state = prepared_orders(spark, folder)
    training = models.training_rows(parts, state, "y")
    first = models.fit_logistic(training)
    start = first.coefficients.toArray(), float(first.intercept)
    model, proof = optimum.polish(training, *start)
    return parts, state, training, model, proof, optimum.certificate(training, *start).objective


def logistic_optimum(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients at the optimum, with the objective there, the objective of the first fit and each gradient component."""
    _, state, _, model, proof, first = _fitted(spark, folder)
    rows = [(name, float(weight), float(slope)) for name, weight, slope in zip([*state.names, "intercept"], [*model.weights, model.intercept], proof.gradient, strict=True)]
    return spark.createDataFrame(rows, "term string, weight double, slope double").select(
        "term", (F.round("weight", 7) + 0.0).alias("weight"), (F.round("slope", 8) + 0.0).alias("slope"),
        F.round(F.lit(proof.objective), 8).alias("objective"), F.round(F.lit(first), 6).alias("fitted_objective"))


#: Newton steps of the SQL version, from coefficients of zero.
NEWTON_STEPS = 8


def _newton_sql(size: int) -> str:
    """Steps b0, b1, ... to the coefficients c0 (intercept), c1, ... over the rows of x (y, w, x1, ..., lam)."""
    names, value = range(size), lambda i: f"x{i}" if i else "1.0"
    steps = ["b0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS c{i}" for i in names) + ")"]
    margin = " + ".join(f"c{i} * {value(i)}" for i in names)
    sums = [f"any_value(c{i}) AS c{i}" for i in names]
    sums += [f"sum(w * (p - y) * {value(i)})" + (f" + any_value(lam) * any_value(c{i})" if i else "") + f" AS g{i}" for i in names]
    sums += [f"sum(w * p * (1 - p) * {value(i)} * {value(j)})" + (" + any_value(lam)" if i == j and i else "") + f" AS h{i}{j}" for i in names for j in range(i + 1)]
    solve = []
    for j in names:  # a symmetric system by triangles and pivots
        solve.append(f"h{j}{j}" + "".join(f" - l{j}{k} * l{j}{k} * d{k}" for k in range(j)) + f" AS d{j}")
        solve += [f"(h{i}{j}" + "".join(f" - l{i}{k} * l{j}{k} * d{k}" for k in range(j)) + f") / d{j} AS l{i}{j}" for i in range(j + 1, size)]
    solve += [f"g{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f" AS z{i}" for i in names]
    solve += [f"z{i} / d{i}" + "".join(f" - l{k}{i} * s{k}" for k in range(i + 1, size)) + f" AS s{i}" for i in reversed(names)]
    for n in range(NEWTON_STEPS):
        steps.append(f"a{n} AS (SELECT {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({margin}))) AS p FROM x, b{n} WHERE split = 'train'))")
        steps.append(f"b{n + 1} AS (SELECT {', '.join(f'c{i} - s{i} AS c{i}' for i in names)} FROM (SELECT *, {', '.join(solve)} FROM a{n}))")
    return ",\n".join(steps)


_FITTED_SQL = f"""WITH {CUTS_SQL},
roll AS (SELECT l_orderkey AS o_orderkey, CAST(count(*) AS DOUBLE) AS line_count, round(sum(l_extendedprice), 2) AS line_amount FROM lineitem GROUP BY 1),
raw AS (SELECT c.o_orderkey, y, split, o_totalprice AS price, line_count, line_amount FROM chrono c LEFT JOIN roll r ON c.o_orderkey = r.o_orderkey),
med AS (SELECT quantile_cont(line_count, 0.5) AS line_count, quantile_cont(line_amount, 0.5) AS line_amount FROM raw WHERE split = 'train'),
f AS (SELECT o_orderkey, y, split, price, coalesce(raw.line_count, med.line_count) AS line_count,
             coalesce(raw.line_amount, med.line_amount) AS line_amount, raw.line_count IS NULL AS without_lines FROM raw, med),
s AS (SELECT avg(price) AS m1, stddev_pop(price) AS s1, avg(line_count) AS m2, stddev_pop(line_count) AS s2, avg(line_amount) AS m3,
             stddev_pop(line_amount) AS s3, count(*) AS n, sum(y) AS n1 FROM f WHERE split = 'train'),
x AS MATERIALIZED (SELECT o_orderkey, split, y, without_lines, (price - m1) / s1 AS x1, (line_count - m2) / s2 AS x2, (line_amount - m3) / s3 AS x3,
                          CASE WHEN y = 1 THEN 0.5 / n1 ELSE 0.5 / (n - n1) END AS w, 1.0 / n AS lam FROM f, s),
{_newton_sql(4)},
b AS MATERIALIZED (SELECT * FROM b{NEWTON_STEPS})"""
LOGISTIC_OPTIMUM_SQL = f"""{_FITTED_SQL},
here AS (SELECT *, 1 / (1 + exp(-(c0 + c1 * x1 + c2 * x2 + c3 * x3))) AS p FROM x, b WHERE split = 'train'),
o AS (SELECT -sum(w * CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) + any_value(lam * (c1 * c1 + c2 * c2 + c3 * c3)) / 2 AS objective,
             sum(w * (p - y)) AS g0, {', '.join(f'sum(w * (p - y) * x{i}) + any_value(lam * c{i}) AS g{i}' for i in (1, 2, 3))} FROM here)
{' UNION ALL '.join(f"SELECT '{term}' AS term, round(c{i}, 7) + 0.0 AS weight, round(g{i}, 8) + 0.0 AS slope, round(objective, 8) AS objective, round(objective, 6) AS fitted_objective FROM b, o"
                    for i, term in enumerate(('intercept', *ORDER_FEATURES)))}
"""


def _stored_scorer(spark: SparkSession, folder: str) -> tuple[DataFrame, scoring.Scorer]:
    """The optimal model on checked splits, saved as a bundle and loaded again."""
    parts, state, training, model, _, _ = _fitted(spark, folder)
    validate_splits(transform_features(parts, state, ["y", "split"]), state.names, "y")
    path = bundle.save_bundle(spark, _folder(spark, "bundle"), scoring.ProbabilityScorer("logistic_regression", model, state),
                              dataset_id="orders", split_strategy="chronological", train_rows=training.total, target="y")
    return parts, bundle.load_bundle(spark, path)[0]


def scored_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Scores, bands and alerts of all orders by the reloaded bundle."""
    parts, scorer = _stored_scorer(spark, folder)
    return scoring.score_batch(parts, scorer, ["o_orderkey", "split"]).withColumns(
        {"raw_score": F.round("raw_score", 7), "score": F.round("score", 5)})


_SCORES_SQL = f"""{_FITTED_SQL},
r AS (SELECT x.*, 1 / (1 + exp(-(c0 + c1 * x1 + c2 * x2 + c3 * x3))) AS p FROM x, b)"""
_BAND_SQL = "CASE WHEN p * 100 < 30 THEN 'low' WHEN p * 100 < 70 THEN 'medium' ELSE 'high' END"
SCORED_ORDERS_SQL = f"""{_SCORES_SQL}
SELECT o_orderkey, split, 'logistic_regression' AS model_name, round(p, 7) AS raw_score, round(p * 100, 5) AS score, {_BAND_SQL} AS risk_level,
       'probability' AS score_kind, '{scoring.PROBABILITY_BASIS}' AS score_basis, p >= 0.5 AS model_alert,
       'positive-class probability >= 0.5' AS decision_method FROM r
"""


def streamed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """All orders as JSON payloads through the scoring stream; orders without lines lack two features and are quarantined."""
    parts, scorer = _stored_scorer(spark, folder)
    inbox, out = _folder(spark, "payloads"), _folder(spark, "stream")
    body = F.to_json(F.struct(*[F.col(c) for c in ORDER_FEATURES]))
    parts.select(F.col("o_orderkey").cast("string").alias("transaction_id"), body.alias("payload")).write.json(inbox)
    flows.write_scored(flows.read_payload_stream(spark, inbox), scorer, out, f"{out}/checkpoint").awaitTermination()
    scored = spark.read.parquet(f"{out}/scored").select(
        "transaction_id", F.round("score", 5).alias("score"), "risk_level", "model_alert", F.lit(None).cast("string").alias("reject_reason"))
    rejected = spark.read.parquet(f"{out}/rejected").select(
        "transaction_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("risk_level"),
        F.lit(None).cast("boolean").alias("model_alert"), "reject_reason")
    return scored.unionByName(rejected).withColumn("o_orderkey", F.col("transaction_id").cast("long")).drop("transaction_id")


STREAMED_ORDERS_SQL = f"""{_SCORES_SQL}
SELECT o_orderkey, CASE WHEN NOT without_lines THEN round(p * 100, 5) END AS score, CASE WHEN NOT without_lines THEN {_BAND_SQL} END AS risk_level,
       CASE WHEN NOT without_lines THEN p >= 0.5 END AS model_alert,
       CASE WHEN without_lines THEN 'missing required features: line_amount, line_count' END AS reject_reason FROM r
"""


# --- streams over the events

def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = read(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")  # a pattern may meet a file or a folder
    return stream.withColumns({"time": F.col("ts").cast("timestamp"), "y": (F.col("event_type") == "error").cast("int")})


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream has put out once all its input is read."""
    out = _folder(spark, name)
    flows.write_stream(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def streamed_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and positives per closed hour; hours that the watermark has not passed stay open."""
    return _drained(spark, flows.stream_trend(_event_stream(spark, folder), "time", "y", width="1 hour", lateness="2 hours"), "trend")


def streamed_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, missing cells and bad numbers per closed day; event types are no numbers."""
    stream = flows.stream_quality(_event_stream(spark, folder), "time", ["value", "event_type", "user_id"])
    return _drained(spark, stream, "quality")


STREAMED_TREND_SQL = """
SELECT date_trunc('hour', ts) AS window_start, count(*) AS transaction_count, count(*) FILTER (WHERE event_type = 'error') AS fraud_count
FROM events GROUP BY 1 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR
"""
STREAMED_QUALITY_SQL = """
SELECT window_start, count(*) AS row_count,
       CAST(sum(CAST(value IS NULL OR isnan(value) AS INT) + CAST(coalesce(trim(event_type), '') = '' AS INT) + CAST(user_id IS NULL AS INT)) AS BIGINT) AS missing_cells,
       CAST(sum(CAST(coalesce(isinf(value), false) AS INT) + CAST(coalesce(trim(event_type), '') <> '' AND try_cast(event_type AS DOUBLE) IS NULL AS INT)) AS BIGINT) AS bad_numbers
FROM (SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start FROM events) GROUP BY 1
HAVING window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
"""


# --- stored evaluations

#: Events from this time on are the test part of the stored evaluation.
TEST_FROM = "2024-01-16"
RULES = {"amount": ("probability", metrics.decision_rule("probability", 0.5)), "inverse": ("probability", metrics.decision_rule("probability", 0.4))}


def _rival_scores(spark: SparkSession, folder: str) -> DataFrame:
    base = events(spark, folder).select(
        F.when(F.col("ts") < F.lit(TEST_FROM).cast("timestamp_ntz"), "validation").otherwise("test").alias("split"), F.col("y").alias("label"), "score")
    both = base.withColumn("model_name", F.lit("amount")).unionByName(base.withColumns({"score": 1 - F.col("score"), "model_name": F.lit("inverse")}))
    return both.withColumn("alert", (F.col("score") >= F.when(F.col("model_name") == "amount", 0.5).otherwise(0.4)).cast("int"))


def _stored_evaluation(spark: SparkSession, folder: str) -> tuple[dict[str, str], DataFrame]:
    """Paths of the written evaluation and the baseline table of two runs, the first of them repeated."""
    scored = _rival_scores(spark, folder)
    metrics.require_scores(scored, "label", "score", "alert", probability=True, keys=("model_name", "split"))
    out = _folder(spark, "evaluation")
    paths = tables.write_evaluation(metrics.evaluate_models(scored), metrics.evaluation_curves(scored), out, RULES)
    written = spark.read.parquet(paths["metrics"])
    for run in ("first", "second", "first"):
        tables.append_baseline(written, f"{out}/baselines", {"threshold": "fixed"}, run)
    return paths, spark.read.parquet(f"{out}/baselines")


def stored_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the test part, read back, with the runs that the baseline table holds for each model."""
    paths, baselines = _stored_evaluation(spark, folder)
    runs = baselines.where(F.col("split") == "test").groupBy("model_name").agg(F.count(F.lit(1)).alias("baseline_rows"), F.max(F.col("config")["threshold"]).alias("setting"))
    out = stored.read_performance(spark, paths["metrics"], "test").join(runs, "model_name")
    return out.withColumns({c: F.round(c, 6) for c in stored.UNIT_METRICS})


def stored_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Curve points of the test part, read back."""
    paths, _ = _stored_evaluation(spark, folder)
    points = spark.read.parquet(paths["curves"]).where(F.col("split") == "test")
    return points.select("model_name", "curve", "place", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_RIVALS_SQL = f"""WITH t AS (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, least(floor(value / 5) / 100, 1.0) AS score
                              FROM events WHERE ts >= '{TEST_FROM}'),
m AS (SELECT 'amount' AS model_name, y, score, score >= 0.5 AS alert FROM t UNION ALL SELECT 'inverse', y, 1 - score, 1 - score >= 0.4 FROM t),
d AS (SELECT model_name, score, sum(y) AS pos, sum(1 - y) AS neg FROM m GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model_name) AS ap, sum(neg) OVER (PARTITION BY model_name) AS an,
             row_number() OVER w AS place, lead(pos) OVER w AS np, lead(neg) OVER w AS nn FROM d WINDOW w AS (PARTITION BY model_name ORDER BY score DESC))"""
STORED_EVALUATION_SQL = f"""{_RIVALS_SQL},
c AS (SELECT model_name, count(*) AS n, count(*) FILTER (WHERE y = 0 AND NOT alert) AS tn, count(*) FILTER (WHERE y = 0 AND alert) AS fp,
             count(*) FILTER (WHERE y = 1 AND NOT alert) AS fn, count(*) FILTER (WHERE y = 1 AND alert) AS tp FROM m GROUP BY 1),
k AS (SELECT model_name, round(sum(neg * (cp - pos / 2.0)) / max(ap * an), 6) AS roc_auc, round(sum(pos * cp / (cp + cn)) / max(ap), 6) AS pr_auc FROM r GROUP BY 1)
SELECT c.model_name, 'test' AS split, n AS row_count, tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive,
       tp + fp AS predicted_positive, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + fn) / n, 6) AS prevalence, round((tp + fp) / n, 6) AS alert_rate,
       roc_auc, pr_auc, 'probability' AS score_kind,
       CASE c.model_name WHEN 'amount' THEN 'probability >= 0.5 (fixed)' ELSE 'probability >= 0.4 (fixed)' END AS decision_rule,
       CAST(2 AS BIGINT) AS baseline_rows, 'fixed' AS setting
FROM c JOIN k ON c.model_name = k.model_name
"""
STORED_CURVES_SQL = f"""{_RIVALS_SQL}
SELECT model_name, 'roc' AS curve, place, round(cn / an, 6) AS x, round(cp / ap, 6) AS y FROM r WHERE place = 1 OR np IS NULL OR np <> pos OR nn <> neg
UNION ALL SELECT DISTINCT model_name, 'roc', CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE FROM r
UNION ALL SELECT model_name, 'pr', place, round(cp / ap, 6), round(cp / (cp + cn), 6) FROM r
UNION ALL SELECT DISTINCT model_name, 'pr', CAST(0 AS BIGINT), 0.0::DOUBLE, 1.0::DOUBLE FROM r
"""


def stored_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Trend and categories of the orders, written as profile tables and read back as one."""
    df = orders(spark, folder)
    made = {"trend": profile.daily_trend(df, "o_orderdate", "y"), "categories": profile.category_summary(df, "o_orderpriority", "y")}
    paths = tables.write_profiles(made, _folder(spark, "profiles"))
    trend = spark.read.parquet(paths["trend"]).select(F.lit("trend").alias("profile"), F.col("day").cast("string").alias("item"), "transaction_count", "fraud_count")
    kinds = spark.read.parquet(paths["categories"]).select(F.lit("categories").alias("profile"), F.col("category").alias("item"), "transaction_count", "fraud_count")
    return trend.unionByName(kinds)


STORED_PROFILES_SQL = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS profile, {item} AS item, count(*) AS transaction_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS fraud_count FROM orders GROUP BY 2"
    for name, item in (("trend", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"), ("categories", "coalesce(o_orderpriority, 'Unknown')")))


# --- CSV files to tables

def _related_files(spark: SparkSession, folder: str) -> str:
    """A folder with the ten related tables as CSV; text that the tables lack is written as unknown."""
    root = _folder(spark, "related")
    for name, df in star_tables(spark, folder).items():
        df.replace("", "unknown").write.option("header", True).option("escape", '"').csv(f"{root}/{name}.csv")
    return root


def related_files(spark: SparkSession, folder: str) -> DataFrame:
    """Load reports of the ten tables, found and read below a folder."""
    root = _related_files(spark, folder)
    return csv.load_reports(spark, csv.read_related_tables(spark, root))


RELATED_FILES_SQL = """
WITH o AS (SELECT count(*) AS n FROM orders), c AS (SELECT count(*) AS n FROM customer), s AS (SELECT count(*) AS n FROM supplier)
SELECT unnest(['fraud_indicators', 'transaction_category_labels', 'amount_data', 'anomaly_scores', 'transaction_metadata', 'transaction_records']) AS table_name,
       n AS row_count, CAST(unnest([2, 2, 2, 2, 3, 3]) AS BIGINT) AS column_count, CAST(0 AS BIGINT) AS missing_cells, CAST(0 AS BIGINT) AS duplicate_rows, 'utf-8' AS encoding FROM o
UNION ALL SELECT unnest(['account_activity', 'customer_data', 'suspicious_activity']), n, unnest([3, 4, 2]), 0, 0, 'utf-8' FROM c
UNION ALL SELECT 'merchant_data', n, 3, 0, 0, 'utf-8' FROM s
"""


def star_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """The audited star, one row per order, from the ten CSV tables."""
    return csv.read_transaction_table(spark, _related_files(spark, folder))[0]


def wide_from_file(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as the wide table: written as CSV, header checked, read, checked for order, split and standardised."""
    path = f"{_folder(spark, 'wide')}/wide.csv"
    vectors = spread(read(spark, folder, "embeddings")).selectExpr(
        "CAST(vec_id AS DOUBLE) AS Time", *[f"CAST(embedding[{i}] AS DOUBLE) AS {c}" for i, c in enumerate(WIDE_COMPONENTS)],
        "round(abs(CAST(embedding[28] AS DOUBLE)) * 100, 2) AS Amount", "CAST(label >= 5 AS INT) AS Class")
    vectors.write.option("header", True).csv(path)
    csv.check_wide_header(spark, path)
    frame = csv.read_wide_table(spark, path).frame
    parts, state = prepare_wide(frame, "Time")
    out = transform_features(parts.withColumn("vec_id", F.col("Time").cast("long")), state, ["vec_id", "split", "Class"])
    validate_splits(out, WIDE_FEATURES, "Class")
    return out.select("vec_id", "split", F.col("Class").alias("class"), *[(F.round(c, 5) + 0.0).alias(c.lower()) for c in WIDE_FEATURES])


WIDE_FROM_FILE_SQL = f"""
WITH w AS (SELECT vec_id, CAST(label >= 5 AS INT) AS class, CAST(vec_id AS DOUBLE) AS time,
                  {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS {c.lower()}' for i, c in enumerate(WIDE_COMPONENTS))},
                  round(abs(CAST(embedding[29] AS DOUBLE)) * 100, 2) AS amount, row_number() OVER (ORDER BY vec_id) AS place, count(*) OVER () AS n FROM embeddings),
p AS (SELECT *, CASE WHEN place <= round_even(n * 0.70, 0) THEN 'train' WHEN place <= round_even(n * 0.85, 0) THEN 'validation' ELSE 'test' END AS split FROM w),
s AS (SELECT {', '.join(f'avg({c.lower()}) AS m_{c.lower()}, stddev_pop({c.lower()}) AS s_{c.lower()}' for c in WIDE_FEATURES)} FROM p WHERE split = 'train')
SELECT vec_id, split, class, {', '.join(f'round(({c} - m_{c}) / s_{c}, 5) + 0.0 AS {c}' for c in map(str.lower, WIDE_FEATURES))} FROM p, s
"""

QUERIES = {
    "logistic_optimum": logistic_optimum, "scored_orders": scored_orders, "streamed_orders": streamed_orders, "streamed_trend": streamed_trend,
    "streamed_quality": streamed_quality, "stored_evaluation": stored_evaluation, "stored_curves": stored_curves, "stored_profiles": stored_profiles,
    "related_files": related_files, "star_from_files": star_from_files, "wide_from_file": wide_from_file,
}
ORACLES = {
    "logistic_optimum": LOGISTIC_OPTIMUM_SQL, "scored_orders": SCORED_ORDERS_SQL, "streamed_orders": STREAMED_ORDERS_SQL,
    "streamed_trend": STREAMED_TREND_SQL, "streamed_quality": STREAMED_QUALITY_SQL, "stored_evaluation": STORED_EVALUATION_SQL,
    "stored_curves": STORED_CURVES_SQL, "stored_profiles": STORED_PROFILES_SQL, "related_files": RELATED_FILES_SQL,
    "star_from_files": RELATED_STAR_SQL, "wide_from_file": WIDE_FROM_FILE_SQL,
}

"""Permutation-Shapley attributions of the 0-100 score, and top contributors.

Cases are expanded by a bounded literal (the coalitions of the drawn feature orders times at most
100 background rows), scored once, and folded straight back to one row per case.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.errors import ValidationError
from riskloom.operators.models import positive_probability
from riskloom.operators.ranks import bottom_by_digest
from riskloom.operators.scoring import Scorer

# Bounds of the explanation request and its tolerance.
MAX_BACKGROUND_ROWS = 100
MAX_EVALS = 10_000
DEFAULT_EVALS = 500
RELATIVE_TOLERANCE, ABSOLUTE_TOLERANCE = 1e-5, 1e-4
#: Cases that a task expands at a time, by up to 100 background rows.
BLOCK_CASES = 256
OUTPUT_SCALE = "risk score on the 0–100 scale"

ScoreRows = Callable[[DataFrame], DataFrame]


def background_sample(df: DataFrame, key: str, limit: int = MAX_BACKGROUND_ROWS, seed: int = 42) -> DataFrame:
    """Seeded sample without replacement of at most 100 rows."""
    if not 1 <= limit <= MAX_BACKGROUND_ROWS:
        raise ValidationError(f"background_rows must be between 1 and {MAX_BACKGROUND_ROWS}")
    return bottom_by_digest(df, key, limit, seed)


def background_rows(df: DataFrame, names: Sequence[str]) -> list[list[float]]:
    """The bounded background as plain numbers."""
    rows = df.select(*[F.col(n).cast("double").alias(n) for n in names]).limit(MAX_BACKGROUND_ROWS + 1).collect()
    if not 1 <= len(rows) <= MAX_BACKGROUND_ROWS:
        raise ValidationError(f"The background must hold 1 to {MAX_BACKGROUND_ROWS} rows")
    values = [[row[n] for n in names] for row in rows]
    if not all(v is not None and np.isfinite(v) for row in values for v in row):
        raise ValidationError("background_features values must be finite")
    return values


def coalition_weights(features: int, max_evals: int, seed: int) -> dict[tuple[bool, ...], np.ndarray]:
    """How much each coalition's value counts toward each feature.

    Feature orders are drawn as max_evals allows and each is walked forward and backward. A feature's
    attribution is the mean change when it joins, so every coalition enters with +1 for the feature
    that just joined and -1 for the one about to join; equal coalitions are evaluated once.
    """
    random = np.random.default_rng(seed)
    orders = []
    for _ in range(max_evals // (2 * features + 1)):
        order = random.permutation(features)
        orders += [order, order[::-1]]
    weights: dict[tuple[bool, ...], np.ndarray] = {}
    for order in orders:
        present = np.zeros(features, dtype=bool)
        for step in range(features + 1):
            weight = weights.setdefault(tuple(bool(p) for p in present), np.zeros(features))
            if step > 0:
                weight[order[step - 1]] += 1.0 / len(orders)
            if step < features:
                weight[order[step]] -= 1.0 / len(orders)
                present[order[step]] = True
    return weights


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def require_unique(cases: DataFrame, key: str) -> None:
    """Raises for repeated or missing case identifiers: attributions are gathered per identifier."""
    if cases.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).count():
        raise ValidationError(f"Case identifiers in {key} must be present and unique")


def _plan(cases: DataFrame, key: str, m: int, background: Sequence, max_evals: int, seed: int) -> dict[tuple[bool, ...], np.ndarray]:
    """Coalition weights of a request within its bounds."""
    if not 2 * m + 1 <= max_evals <= MAX_EVALS:
        raise ValidationError(f"max_evals must be an integer from {2 * m + 1} to {MAX_EVALS}")
    if not 1 <= len(background) <= MAX_BACKGROUND_ROWS:
        raise ValidationError(f"The background must hold 1 to {MAX_BACKGROUND_ROWS} rows")
    require_unique(cases, key)
    return coalition_weights(m, max_evals, seed)


def shapley_blocks(cases: DataFrame, key: str, names: Sequence[str], background: Sequence[Sequence[float]], evaluate: Callable[[np.ndarray], np.ndarray], *,
                   max_evals: int = DEFAULT_EVALS, seed: int = 42) -> DataFrame:
    """`shapley_values` for a score that is a function of rows of numbers, 0 to 100.

    Cases stay where they are: a block of them meets every coalition and background row inside its task, and means over the
    background are all that leaves it. Nothing is shuffled.
    """
    m = len(names)
    weights = _plan(cases, key, m, background, max_evals, seed)
    rows = np.array(background, np.float64)
    baseline = float(np.mean(evaluate(rows)))
    plan = [(np.array(on), w) for on, w in weights.items() if any(on)]
    start = weights[tuple([False] * m)] * baseline

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_CASES):
                part = batch.slice(at, BLOCK_CASES)
                x = np.column_stack([part.column(n).to_numpy(zero_copy_only=False) for n in names])
                score, phi = evaluate(x), np.tile(start, (len(x), 1))
                for on, w in plan:
                    value = score if on.all() else evaluate(np.where(on, x[:, None, :], rows[None]).reshape(-1, m)).reshape(len(x), -1).mean(axis=1)
                    phi += value[:, None] * w
                additive = np.abs(baseline + phi.sum(axis=1) - score) <= ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * np.abs(score)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), m).cast(pa.list_(pa.float64())) for v in (x, phi)]
                yield pa.RecordBatch.from_arrays([part.column("__key"), lists[0], pa.array(score), pa.array(np.full(len(x), baseline)), lists[1], pa.array(additive)],
                                                 ["__key", "own", "score", "baseline_score", "shap", "additive"])

    kind = cases.schema[key].dataType.simpleString()
    given = cases.select(F.col(key).alias("__key"), *[F.col(n).cast("double").alias(n) for n in names])
    out = given.mapInArrow(run, f"__key {kind}, own array<double>, score double, baseline_score double, shap array<double>, additive boolean")
    return out.withColumnRenamed("__key", key)


def shapley_values(cases: DataFrame, key: str, names: Sequence[str], background: Sequence[Sequence[float]],
                   score_rows: ScoreRows, *, max_evals: int = DEFAULT_EVALS, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """One row per case: key, score, baseline_score, shap (array in feature order), additive.

    `cases` holds the key and feature columns. `score_rows` adds a 0-100 `score` to any frame with
    an array column `x`. `additive` tells whether baseline plus attributions reproduce the score.
    """
    m = len(names)
    weights = _plan(cases, key, m, background, max_evals, seed)
    empty, full = tuple([False] * m), tuple([True] * m)
    spark = cases.sparkSession
    alone = spark.createDataFrame([([float(v) for v in row],) for row in background], "x array<double>")
    baseline = score_rows(alone).agg(F.avg("score")).first()[0]

    # The full coalition does not depend on the background, so it is scored once per case.
    plan = [{"on": list(k), "w": list(w), "last": k == full} for k, w in weights.items() if k != empty]
    steps = _literal(plan, "array<struct<on:array<boolean>,w:array<double>,last:boolean>>")
    rows = _literal([[float(v) for v in row] for row in background], "array<array<double>>")
    # Each case grows by a bounded factor; spreading cases first keeps the growth parallel.
    spread = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = F.array(*[F.col(n).cast("double") for n in names])
    expanded = (
        cases.select(F.col(key), own.alias("own")).repartition(spread, key)
        .select(key, "own", F.explode(steps).alias("c"))
        .select(key, "own", "c.w", "c.last", "c.on",
                F.explode(F.when(F.col("c.last"), F.slice(rows, 1, 1)).otherwise(rows)).alias("b"))
        .select(key, "own", "w", "last", F.zip_with(
            F.zip_with("own", "b", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), "on",
            lambda pair, on: F.when(on, pair["a"]).otherwise(pair["b"])).alias("x"))
    )
    scored = score_rows(expanded)
    share = F.when(F.col("last"), F.col("score")).otherwise(F.col("score") / len(background))
    folded = scored.groupBy(key).agg(
        F.max(F.when(F.col("last"), F.col("score"))).alias("score"),
        F.first("own").alias("own"),
        *[F.sum(share * F.col("w")[j]).alias(f"phi{j}") for j in range(m)],
    )
    start = weights[empty]
    shap = F.array(*[F.col(f"phi{j}") + F.lit(float(start[j] * baseline)) for j in range(m)])
    out = folded.select(key, "own", "score", F.lit(float(baseline)).alias("baseline_score"), shap.alias("shap"))
    rebuilt = F.col("baseline_score") + F.aggregate("shap", F.lit(0.0), lambda acc, v: acc + v)
    tolerance = ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * F.abs("score")
    return out.withColumn("additive", F.abs(rebuilt - F.col("score")) <= tolerance)


def attributions(df: DataFrame, names: Sequence[str]) -> Column:
    """array<struct<feature_name, feature_value, shap_value>> in feature order."""
    labels = F.array(*[F.lit(n) for n in names])
    return F.zip_with(F.zip_with(labels, "own", lambda n, v: F.struct(n.alias("n"), v.alias("v"))), "shap",
                      lambda pair, s: F.struct(pair["n"].alias("feature_name"), pair["v"].alias("feature_value"), s.alias("shap_value")))


def explain_cases(cases: DataFrame, key: str, scorer: Scorer, background: Sequence[Sequence[float]], *,
                  max_evals: int = DEFAULT_EVALS, seed: int = 42) -> DataFrame:
    """Local explanations of prepared feature rows, one row per case."""
    names = scorer.state.names
    evaluate = scorer.evaluator()
    if evaluate is None:
        out = shapley_values(cases, key, names, background, scorer_rows(scorer), max_evals=max_evals, seed=seed)
    else:
        out = shapley_blocks(cases, key, names, background, evaluate, max_evals=max_evals, seed=seed)
    return out.select(
        key, F.lit(scorer.model_name).alias("model_name"), F.lit(scorer.score_kind).alias("score_kind"),
        F.lit(scorer.basis).alias("score_basis"), "score", "baseline_score", F.lit(OUTPUT_SCALE).alias("output_scale"),
        attributions(out, names).alias("attributions"), F.lit(max_evals).alias("max_evals"), "additive",
    )


def scorer_rows(scorer: Scorer) -> ScoreRows:
    """Scores an array column `x` of prepared features on the scorer's 0-100 scale."""
    direct = scorer.raw_of([F.col("x")[i] for i in range(len(scorer.state.names))])

    def score(df: DataFrame) -> DataFrame:
        raw = positive_probability(scorer.model, df.withColumn("features", array_to_vector("x"))).drop("features") if direct is None else df.withColumn("raw_score", direct)
        return scorer.scaled(raw).drop("raw_score")

    return score


def require_additive(explained: DataFrame) -> DataFrame:
    if explained.where(~F.coalesce(F.col("additive"), F.lit(False))).limit(1).count():
        raise ValidationError("Attributions do not reconstruct the model score")
    return explained


def top_of_array(column: str, k: int) -> Column:
    """First k attributions by absolute value; equal ones keep feature order."""
    order = lambda a, b: (
        F.when(F.abs(a["e"]["shap_value"]) > F.abs(b["e"]["shap_value"]), -1)
        .when(F.abs(a["e"]["shap_value"]) < F.abs(b["e"]["shap_value"]), 1)
        .otherwise(a["i"] - b["i"]))
    numbered = F.transform(column, lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(numbered, order), 1, k), lambda p: p["e"])


def top_contributors(df: DataFrame, case: str, value: Column, ties: Sequence[str], k: int = 5) -> DataFrame:
    """Long form: the k rows of each case with the largest absolute value, with their `place`.

    The rank filter is applied before the shuffle as well as after it, so a huge case sends at most
    k rows per map task.
    """
    if k < 1:
        raise ValidationError("top_contributors must be at least 1")
    window = Window.partitionBy(case).orderBy(F.abs(value).desc(), *ties)
    return df.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)

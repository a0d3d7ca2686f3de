"""Fitted bundles: model, feature state, anomaly reference and a manifest written last.

A bundle is immutable and complete exactly when its manifest exists.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import SparkSession, functions as F

from riskloom.errors import ValidationError
from riskloom.operators.features import FeatureState
from riskloom.operators.forests import StoredForest, forest_of_nodes
from riskloom.operators.iforest import IsolationForest, forest_from_nodes
from riskloom.operators.optimum import LogisticModel, model_from_weights
from riskloom.operators.percentiles import build_index
from riskloom.operators.scoring import ANOMALY_BASIS, PROBABILITY_BASIS, AnomalyScorer, BandPolicy, ProbabilityScorer, Scorer
from riskloom.operators.trees import TreeEnsemble, ensemble_from_nodes

FORMAT_VERSION = 1
PROBABILITY_MODELS = ("LogisticRegressionModel", "LogisticModel", "TreeEnsemble", "StoredForest")
#: Score kind and basis that belong to each kind of model.
SCALES = dict.fromkeys(PROBABILITY_MODELS, ("probability", PROBABILITY_BASIS)) | {"IsolationForest": ("anomaly", ANOMALY_BASIS)}


def _text(value: Any) -> bool:
    return isinstance(value, str) and bool(value.strip())


def _bands(value: Any) -> bool:
    try:
        BandPolicy(**value)
    except (TypeError, ValidationError):
        return False
    return True


#: For every field of a manifest, what its value must satisfy beside the scale (kind, basis) of its model.
RULES: dict[str, Callable[[Any, tuple], bool]] = {
    "format_version": lambda v, scale: v == FORMAT_VERSION,
    "model_type": lambda v, scale: v in SCALES,
    "model_name": lambda v, scale: _text(v),
    "model_config": lambda v, scale: isinstance(v, dict),
    "score_kind": lambda v, scale: v == scale[0],
    "score_basis": lambda v, scale: v == scale[1],
    "decision_threshold": lambda v, scale: v is None if scale[0] == "anomaly" else isinstance(v, (int, float)) and 0 <= v <= 1,
    "sample": lambda v, scale: (v is not None) == (scale[0] == "anomaly"),
    "risk_policy": lambda v, scale: _bands(v),
    "feature_names": lambda v, scale: isinstance(v, list) and 0 < len(set(v)) == len(v),
    "target_column": lambda v, scale: _text(v),
    "dataset_id": lambda v, scale: _text(v) and ":" not in v and not v.startswith("/"),
    "split_strategy": lambda v, scale: _text(v),
    "train_rows": lambda v, scale: isinstance(v, int) and v > 0,
}


def _read_manifest(spark: SparkSession, path: str) -> dict | None:
    try:
        rows = spark.read.text(f"{path}/manifest", wholetext=True).limit(2).collect()
    except AnalysisException:
        return None
    return json.loads(rows[0][0]) if len(rows) == 1 else None


def _settings(model: Any) -> dict[str, Any]:
    if isinstance(model, IsolationForest):
        return {"trees": len(model.roots), "sample": model.sample}
    if isinstance(model, TreeEnsemble):
        return {"trees": len(model.roots), "kind": model.kind}
    if isinstance(model, StoredForest):
        return {"trees": model.trees, "kind": model.kind}
    if isinstance(model, LogisticModel):
        return {"features": model.numFeatures}
    return {p.name: str(v) for p, v in model.extractParamMap().items()}


def save_bundle(spark: SparkSession, path: str, scorer: Scorer, *, dataset_id: str, split_strategy: str,
                train_rows: int, target: str = "Class") -> str:
    """Writes a new bundle; an existing one is never replaced."""
    path = path.rstrip("/")
    anomaly = scorer.score_kind == "anomaly"
    manifest = {
        "format_version": FORMAT_VERSION, "model_name": scorer.model_name, "model_type": type(scorer.model).__name__,
        "target_column": target, "dataset_id": dataset_id.strip(), "score_kind": scorer.score_kind, "score_basis": scorer.basis,
        "decision_threshold": scorer.threshold, "feature_names": list(scorer.state.names), "split_strategy": split_strategy.strip(),
        "train_rows": train_rows, "model_config": _settings(scorer.model),
        "risk_policy": {"low_upper": scorer.policy.low_upper, "medium_upper": scorer.policy.medium_upper},
        "sample": scorer.model.sample if anomaly else None,
    }
    check_manifest(manifest)
    if anomaly and scorer.reference_rows != train_rows:
        raise ValidationError(f"{scorer.reference_rows} reference scores for {train_rows} training rows")
    if _read_manifest(spark, path) is not None:
        raise ValidationError(f"Bundles are immutable and {path} holds one")
    # Without its manifest a bundle does not count, so what an interrupted save left behind is written over.
    if anomaly:
        scorer.model.node_frame(spark.range(0)).write.mode("overwrite").parquet(f"{path}/model")
        scorer.reference.table().write.mode("overwrite").parquet(f"{path}/reference")
    elif isinstance(scorer.model, (TreeEnsemble, StoredForest)):
        scorer.model.node_frame(spark.range(0)).write.mode("overwrite").parquet(f"{path}/model")
    elif isinstance(scorer.model, LogisticModel):
        scorer.model.weight_frame(spark).write.mode("overwrite").parquet(f"{path}/model")
    else:
        scorer.model.write().overwrite().save(f"{path}/model")
    _write_text(spark, scorer.state.to_json(), f"{path}/state", "overwrite")
    _write_text(spark, json.dumps(manifest, sort_keys=True, ensure_ascii=False), f"{path}/manifest", "errorifexists")
    return path


def _write_text(spark: SparkSession, text: str, path: str, mode: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def check_manifest(manifest: dict) -> None:
    """Raises with the names of all fields that are absent, unknown or break their rule."""
    scale = SCALES.get(manifest.get("model_type"), (None, None))
    broken = sorted(name for name, rule in RULES.items() if name not in manifest or not rule(manifest[name], scale))
    if broken or (unknown := sorted(manifest.keys() - RULES.keys())):
        raise ValidationError(f"Unusable bundle manifest: check {broken or unknown}")


def load_bundle(spark: SparkSession, path: str) -> tuple[Scorer, dict]:
    """The scorer and manifest of a complete bundle, after contract checks."""
    path = path.rstrip("/")
    manifest = _read_manifest(spark, path)
    if manifest is None:
        raise ValidationError(f"No complete bundle in {path}: its manifest is missing")
    check_manifest(manifest)
    state = FeatureState.from_json(spark.read.text(f"{path}/state").first()[0])
    if state.names != manifest["feature_names"]:
        raise ValidationError("The stored feature state has other features than the manifest")
    policy = BandPolicy(**manifest["risk_policy"])
    if manifest["score_kind"] == "probability":
        if manifest["model_type"] == "TreeEnsemble":
            model = ensemble_from_nodes(spark.read.parquet(f"{path}/model").toPandas(), state.names, manifest["model_config"]["kind"])
        elif manifest["model_type"] == "StoredForest":
            model = forest_of_nodes(spark.read.parquet(f"{path}/model"), state.names, manifest["model_config"]["trees"])
        elif manifest["model_type"] == "LogisticModel":
            model = model_from_weights(spark.read.parquet(f"{path}/model").collect())  # one row per feature
        else:
            model = LogisticRegressionModel.load(f"{path}/model")
        return ProbabilityScorer(manifest["model_name"], model, state, policy=policy, threshold=manifest["decision_threshold"]), manifest
    nodes = spark.read.parquet(f"{path}/model").toPandas()  # bounded by the forest settings
    start = nodes.groupby("tree")["node"].transform("min")
    for c in ("node", "below", "above"):
        nodes[c] = nodes[c].where(nodes[c] < 0, nodes[c] - start)
    forest = forest_from_nodes(nodes, state.names, manifest["sample"])
    reference = build_index(spark.read.parquet(f"{path}/reference"), "score", F.col("reference_rows"))
    if reference.rows != manifest["train_rows"] or reference.unusable:
        raise ValidationError(f"The stored reference has {reference.rows} rows and {reference.unusable} unusable ones where the manifest says {manifest['train_rows']}")
    return AnomalyScorer(manifest["model_name"], forest, state, reference, policy=policy), manifest

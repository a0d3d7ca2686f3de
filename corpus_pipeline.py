"""Corpus preparation in five stages: toxic documents go, near duplicates go, secrets are masked, sources are mixed, texts are
encoded. Each stage takes the documents that the one before wrote and returns a DataFrame; all but the last keep the columns
of documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import bpe, mixing, secrets, setsketch, toxicity
from riskloom.llm.storage import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below a half; the model learns from the labelled rows of docs that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(~toxicity.held_out(F.col("doc_id"))))
    kept = {c: f"_kept_{i}" for i, c in enumerate(docs.columns)}
    scored = toxicity.score(docs.select(*[F.col(c).alias(k) for c, k in kept.items()], "text"), model)
    return scored.where("score < 0.5").select(*[F.col(k).alias(c) for c, k in kept.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: that of the smallest doc_id.

    Rows that repeat a doc_id count as one document and one of them stays.
    """
    found = setsketch.near_duplicates(docs.select("doc_id", "text"), length=5, percent=80)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    one = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows the new text."""
    texts = docs.select(F.col("text").cast("string"))
    model = secrets.train(secrets.base_spans(texts, []).select(*secrets.KINDS), texts)
    masked = secrets.redacted(docs, model)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the mix takes them: weights 5, 2, 1, 150 % of all words, at most twice."""
    return mixing.mixed_rows(docs, percent=150, most=2, weights=(5, 2, 1))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row."""
    import public_tokenizers

    out = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_to_weights),
    ("bpe", encode),
]

#: The toxicity model and the token automaton have no SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

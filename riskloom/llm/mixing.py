"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 60-bit hash. A source that is to give a share of its words takes the documents whose hash lies
below a threshold, found by summing words per source and hash bucket and refining only the bucket that holds the boundary.
Thresholds are nested: a larger budget keeps all that a smaller one took. Nothing is sorted and no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from riskloom.llm.storage import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
STEP_BITS, STEPS = 12, 5


def document_hash(doc_id: Column, text: Column) -> Column:
    """First 60 bits of MD5 over id and text; equal rows have equal hashes, whatever the order of the table."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _ranked(totals: DataFrame) -> DataFrame:
    """Position of each source in code point order (null last), from per-partition counts of a range-partitioned sort."""
    ordered = checkpoint(totals.orderBy(F.col("source").asc_nulls_last()))
    ordered = ordered.withColumn("part", F.spark_partition_id()).withColumn(
        "local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = dict(ordered.groupBy("part").count().collect())
    before, at = {}, 0
    for part in sorted(counts):
        before[part], at = at, at + counts[part]
    offset = F.element_at(F.create_map(*[F.lit(x) for item in before.items() for x in item]), F.col("part")) if before else F.lit(0)
    return ordered.withColumn("rank", offset + F.col("local")).drop("part", "local")


def source_targets(totals: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from totals(source, source_size): weighted shares of percent of all words.

    Weights repeat over the sources in order. A target above `most` times its source's size stops there, and what is left
    goes to the others by weight until none is above. Only sums travel to the driver.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = checkpoint(_ranked(totals).withColumn("weight", weight))
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level, held = percent * whole / 100, 0.0, -1
    while True:
        above = most * F.col("source_size") < F.lit(level) * F.col("weight")
        fixed, free, n = ranked.agg(F.sum(F.when(above, most * F.col("source_size")).otherwise(0)),
                                    F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if n == held or not free:
            break
        held, level = n, (budget - fixed) / free
    target = F.least(F.lit(level) * F.col("weight"), (most * F.col("source_size")).cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, limit): the rows of a source with hash below limit have words nearest to the source's budget.

    rows(source, hash, size), budgets(source, budget) with budgets below the source's total. A histogram of 4096 buckets per
    source finds the bucket that holds the boundary; only its rows are looked at again, until it holds one hash.
    """
    key = lambda a, b: a["source"].eqNullSafe(b["source"])
    bounds = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for step in range(1, STEPS + 1):
        shift = STEP_BITS * (STEPS - step)
        inside = rows.join(bounds, key(rows, bounds)).where(F.shiftright("hash", shift + STEP_BITS) == F.col("prefix")).drop(bounds["source"])
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("left").alias("left"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        found = sums.withColumn("before", F.coalesce(before, F.lit(0)))
        found = found.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
        bounds = checkpoint(found.select("source", F.col("bucket").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), "words", "low", "high"))
        if bounds.where("low != high").isEmpty():
            break
    return bounds.select("source", (F.col("low") + (2 * F.col("left") >= F.col("words")).cast("long")).alias("limit"))


def _sized(docs: DataFrame) -> dict[str, Column]:
    text = F.col("text").cast("string")
    return {"size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"), "hash": document_hash(F.col("doc_id"), text)}


def mixing_plan(docs: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, source, size, hash) and for each source (s, source_size, target, whole, limit)."""
    rows = checkpoint(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), *[c.alias(k) for k, c in _sized(docs).items()]))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = checkpoint(source_targets(totals, percent, most, weights).withColumn(
        "whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")))
    budgets = targets.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    limits = thresholds(rows, budgets)
    plan = targets.join(limits.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.select(F.col("source").alias("s"), "source_size", "target", "whole", F.coalesce("limit", F.lit(0)).alias("limit"))
    return rows, checkpoint(plan)


def copies() -> Column:
    """How often the mix takes a row that is joined with its source's plan."""
    return F.col("whole") + (F.col("hash") < F.col("limit")).cast("long")


def mix_sources(docs: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs(doc_id, text, source).

    size is the number of words (null text: 0); copies is how often the mix takes the document, at most `most`; taken is
    copies times size. A source's sum of taken differs from its target by at most half the words of the rows that share the
    boundary hash. Rows equal in id and text are taken alike; a null source is a source; empty texts, and sources without
    words, take no words; no rows give none. Other columns are ignored.
    """
    rows, plan = mixing_plan(docs, percent, most, weights)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", copies().alias("copies"), (copies() * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs as often as the mix takes them, with docs' columns; texts travel only if the plan must be shuffled."""
    _, plan = mixing_plan(docs, percent, most, weights)
    kept = {c: f"_kept_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(k) for c, k in kept.items()], *[c.alias(k) for k, c in _sized(docs).items()], F.col("source").cast("string").alias("_source"))
    taken = rows.join(plan, F.col("_source").eqNullSafe(F.col("s"))).where(copies() > 0)
    repeated = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies())))
    return repeated.select(*[F.col(k).alias(c) for c, k in kept.items()])

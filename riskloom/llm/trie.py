"""Prefix trie of conversations by collapse of whole sequences.

Identical conversations become one weighted sequence with a list of its ends; sequences that are proper prefixes of others go
by an anti-join, which leaves the leaves; weighted prefixes are then aggregated to nodes. A prefix is known by its length and
three sums, modulo 2**60, of digests of (position, role, text): sums combine in any order, so neither a long conversation nor
a common first turn needs one task. Texts never leave the scan; what is shuffled are digests and counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.llm.storage import stored

#: Positions that one task sums at most for a conversation.
BLOCK = 4096
GROUP, HEAD = 20, 4
_LANES = ("k0", "k1", "k2")
_KEY = ("depth", *_LANES)
_SIZE = 1 << 60


def head_length(conv_id: Column) -> Column:
    """Turns taken over from the first conversation of the group of twenty: 0 to 3."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEAD


def running(rows: DataFrame, key: str, block: str, order: list[Column], columns: list[str]) -> DataFrame:
    """rows with run_<column>: the sum from the key's first row on, blocks summed apart and joined by their totals."""
    inside = Window.partitionBy(key, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, block).agg(*[F.sum(c).alias(c) for c in columns])
    offsets = totals.select(key, block, *[F.sum(c).over(before).alias(f"before_{c}") for c in columns])
    offsets = offsets.where(F.col(f"before_{columns[0]}").isNotNull())
    summed = rows.select("*", *[F.sum(c).over(inside).alias(f"inside_{c}") for c in columns]).join(offsets, [key, block], "left")
    return summed.select(*rows.columns, *[(F.col(f"inside_{c}") + F.coalesce(f"before_{c}", F.lit(0))).alias(f"run_{c}") for c in columns])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, number from 1, digest, words) of every turn, in order of turn, nulls first, equal ones by digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.lit(1).cast("long").alias("number"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    found = running(rows, "conv", "block", [F.col("turn").asc_nulls_first(), F.col("digest")], ["number"])
    return found.select("conv", F.col("run_number").alias("number"), "digest", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, depth, digest, words) of all rebuilt conversations, with a textless row at depth 0 for each."""
    donor = F.col("conv") - F.col("conv") % GROUP
    heads = turns.where((F.col("number") < HEAD) & (F.col("conv") % GROUP == 0)).withColumnRenamed("conv", "donor")
    have = heads.groupBy("donor").agg(F.count("*").alias("have"))
    own = turns.withColumn("donor", donor).where(F.col("number") > head_length(F.col("conv"))).join(have, "donor", "left")
    own = own.select("conv", (F.col("number") - head_length(F.col("conv")) + F.least(head_length(F.col("conv")), F.coalesce("have", F.lit(0)))).alias("depth"), "digest", "words")
    ids = turns.select("conv").distinct()
    taken = ids.withColumn("donor", donor).join(heads, "donor").where(F.col("number") <= head_length(F.col("conv")))
    taken = taken.select("conv", F.col("number").alias("depth"), "digest", "words")
    roots = ids.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(taken).unionByName(roots)


def _lanes(digest: str) -> list[Column]:
    """Three 60-bit numbers of a turn at its place; nought for the root."""
    placed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col(digest)).cast("binary"), 256)
    return [F.coalesce(F.conv(F.substring(placed, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias(k) for i, k in enumerate(_LANES)]


def _wrapped(name: str, to: str) -> Column:
    return F.pmod(F.col(name), F.lit(_SIZE).cast("decimal(38,0)")).cast("long").alias(to)


def _end_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each run of equal keys; rows come sorted, so a list of any length is hashed as it streams by."""
    now, digest = None, None

    def row(key: tuple, found: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in key], pa.array([found])], [*_KEY, "ends_sha256"])

    for batch in batches:
        done: list[tuple] = []
        keys = zip(*[batch.column(k).to_pylist() for k in _KEY], strict=True)
        for key, conv in zip(keys, batch.column("conv").to_pylist(), strict=True):
            if key == now:
                digest.update(b",%d" % conv)
            else:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(b"%d" % conv)
        if done:
            columns = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1])], [*_KEY, "ends_sha256"])
    if now is not None:
        yield row(now, digest.hexdigest())


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, from the root of depth 0.

    conversations has conv_id, turn, role, text; other columns are ignored. Rows without conv_id are left out; null roles and
    texts are empty; turns come in order of turn, nulls first, and equal turns (repeated rows too, which all count) in order
    of a digest of role and text. A conversation that keeps no turn is a member of the root. No rows give no nodes.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    saved_tokens is (n_convs - 1) times the words of the last text, over the subtree: the words that members have below the
    parent, less those of each node once. A node counts at its owner, the smallest leaf below it; what a leaf owns is an end
    of its path, so the second part is a sum over leaves of a difference of running totals.
    """
    turns = stored(numbered_turns(conversations), "turns")
    rows = stored(rebuilt(turns).select("conv", "depth", "words", *_lanes("digest")), "rebuilt")
    whole = rows.groupBy("conv").agg(F.max("depth").alias("depth"), *[F.sum(k).alias(f"sum_{k}") for k in _LANES], F.sum("words").alias("all_words"))
    whole = whole.select("conv", "depth", *[_wrapped(f"sum_{k}", k) for k in _LANES], "all_words")
    sequences = stored(whole.groupBy(*_KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("weight"), F.min("all_words").alias("all_words")), "sequences")
    ends = whole.select(*_KEY, "conv").repartition(*_KEY).sortWithinPartitions(*_KEY, "conv")
    ends = ends.mapInArrow(_end_lists, "depth long, k0 long, k1 long, k2 long, ends_sha256 string")

    paths = rows.join(sequences.select("conv", F.col("depth").alias("last"), "weight", "all_words"), "conv")
    paths = running(paths.withColumn("block", F.floor(F.col("depth") / BLOCK)), "conv", "block", [F.col("depth")], [*_LANES, "words"])
    step = [(F.col(f"run_{k}") - F.col(k)).alias(f"past_{k}") for k in _LANES]
    paths = paths.select("*", *step).select(
        "conv", "depth", "last", "weight", "all_words", (F.col("run_words") - F.col("words")).alias("past_words"),
        *[_wrapped(f"run_{k}", k) for k in _LANES], *[_wrapped(f"past_{k}", f"up_{k}") for k in _LANES])
    paths = stored(paths, "paths")

    inner = paths.where(F.col("depth") < F.col("last")).select(*_KEY).distinct()
    leaves = sequences.join(inner, list(_KEY), "left_anti").select("conv", F.lit(True).alias("leaf"))
    paths = stored(paths.join(leaves, "conv", "left"), "leaves")
    nodes = stored(paths.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("conv"))).alias("owner"), F.min("past_words").alias("past_words"),
        F.sum(F.col("weight") * (F.col("all_words") - F.col("past_words"))).alias("member_words"), *[F.min(f"up_{k}").alias(f"up_{k}") for k in _LANES]), "nodes")
    owned = nodes.groupBy("owner").agg(F.min("past_words").alias("owned_from"))

    below = paths.where("leaf").join(owned, F.col("conv") == F.col("owner")).select(
        *_KEY, (F.col("all_words") - F.greatest("past_words", "owned_from")).alias("node_words"), F.lit(0).alias("child"), F.lit(None).cast("string").alias("ends_sha256"))
    children = nodes.where("depth > 0").select(
        (F.col("depth") - 1).alias("depth"), *[F.col(f"up_{k}").alias(k) for k in _LANES], F.lit(0).alias("node_words"), F.lit(1).alias("child"), F.lit(None).cast("string").alias("ends_sha256"))
    lists = ends.select(*_KEY, F.lit(0).alias("node_words"), F.lit(0).alias("child"), "ends_sha256")
    parts = below.unionByName(children).unionByName(lists).groupBy(*_KEY).agg(
        F.sum("node_words").alias("node_words"), F.sum("child").alias("n_children"), F.max("ends_sha256").alias("ends_sha256"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(f"up_{k}") for k in _LANES], F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parts, list(_KEY)).join(parents, ["depth", *[f"up_{k}" for k in _LANES]], "left")
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("member_words") - F.col("node_words")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))

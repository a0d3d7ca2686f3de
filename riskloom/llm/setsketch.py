"""Near-duplicate documents by SetSketch registers: banding, joint likelihood estimate, then the full sets.

Each word shingle draws one point per register from an exponential distribution; a register keeps the smallest point of
the set, truncated to an exponentially spaced scale of base b. Points come in stratified order and visit the registers in
a pseudo-random order without repetition, so most shingles are done after a few draws. Registers merge by maximum.
Runs of registers (bands) that agree propose links. A bucket never gives all its pairs: its members meet one pivot, another
in each band. Where that leaves several components in a bucket, documents outside the main one are compared with the rest in
blocks that give out links alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm import words
from riskloom.llm.graph import components
from riskloom.llm.storage import checkpoint

ARENA = 256  # documents of a block that is compared on full sets
LIKELY = 12.5  # log-likelihood a pair may lack at the threshold; below that it is dropped before the full sets (5 sigma)


class SetSketch(NamedTuple):
    """Parameters: registers (a power of two), base, rate, highest register value, registers per band."""

    registers: int = 256
    base: float = 1.001
    rate: float = 20.0
    top: int = 65_534
    band: int = 5

    @property
    def bands(self) -> int:
        return self.registers // self.band

    def draw(self, elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Registers (uint16) of each set; set i holds elements[offsets[i]:offsets[i + 1]], distinct 64-bit values."""
        m, sets = self.registers, len(offsets) - 1
        lowest = np.full((sets, m), np.iinfo(np.uint64).max, np.uint64)
        flat, owner = lowest.reshape(-1), np.repeat(np.arange(sets), np.diff(offsets))
        seed = words.mix(elements + np.uint64(0x51ED270B7F3A2C49))
        start, stride = seed & np.uint64(m - 1), (seed >> np.uint64(20)) & np.uint64(m - 1) | np.uint64(1)
        for step in range(m):
            at = ((start + np.uint64(step) * stride) & np.uint64(m - 1)).astype(np.int64) + owner * m
            free = np.flatnonzero(flat[at] >> np.uint64(48) >= step)
            point = words.mix(seed[free] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(16)
            np.minimum.at(flat, at[free], point | np.uint64(step << 48))
            if step % 4 == 3 or step < 4:
                open_sets = (lowest[np.unique(owner)] >> np.uint64(48) > step).any(axis=1)
                going = np.zeros(sets, bool)
                going[np.unique(owner)[open_sets]] = True
                keep = going[owner]
                if not keep.any():
                    break
                owner, seed, start, stride = owner[keep], seed[keep], start[keep], stride[keep]
        share = np.minimum(lowest.astype(np.float64) / (m * 2.0**48), 1 - 1e-16)
        with np.errstate(divide="ignore"):
            level = np.floor(1 - np.log(-np.log1p(-share) / self.rate) / np.log(self.base))
        level[np.diff(offsets) == 0] = 0
        return np.clip(level, 0, self.top + 1).astype(np.uint16)

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Registers of the union of the sets behind a and b."""
        return np.maximum(a, b)

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        """One signed 64-bit key for each set and band."""
        used = registers[:, : self.bands * self.band].astype(np.uint64).reshape(-1, self.bands, self.band)
        key = np.repeat(words.mix(np.arange(1, self.bands + 1, dtype=np.uint64))[None, :], len(used), axis=0)
        for i in range(self.band):
            key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + used[:, :, i])
        return key.view(np.int64)

    def joint(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: float) -> tuple[np.ndarray, np.ndarray]:
        """Maximum-likelihood Jaccard similarity of each pair, and how much log-likelihood is lost by assuming at least `at`."""
        above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
        same = self.registers - above - below
        u = n_a / (n_a + n_b)
        v = 1 - u
        most = np.minimum(u / v, v / u)

        def p(x: np.ndarray) -> np.ndarray:
            return -np.log1p(-np.clip(x, 0, 1) * (self.base - 1) / self.base) / np.log(self.base)

        def fit(j: np.ndarray) -> np.ndarray:
            up, down = p(u - v * j), p(v - u * j)
            tiny = 1e-12
            return (above * np.log(np.maximum(up, tiny)) + below * np.log(np.maximum(down, tiny))
                    + same * np.log(np.maximum(1 - up - down, tiny)))

        low, high = np.zeros(len(u)), most.copy()
        for _ in range(40):
            third = (high - low) / 3
            left = fit(low + third) < fit(high - third)
            low, high = np.where(left, low + third, low), np.where(left, high, high - third)
        best = (low + high) / 2
        lost = np.where(best >= at, 0.0, np.where(most < at, np.inf, fit(best) - fit(np.minimum(at, most))))
        return best, lost


def shingle_sets(chunk: words.Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their offsets; a text of fewer words is one shingle."""
    hashes = chunk.hashes(lower=True)
    counts = np.diff(chunk.offsets)
    windows, _ = words.window_hashes(hashes, chunk.offsets, length)
    sizes = np.where(counts >= length, counts - length + 1, np.minimum(counts, 1))
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    owner = np.repeat(np.arange(chunk.rows), sizes)
    short = (counts < length)[owner]
    out[~short] = windows
    few = np.flatnonzero((counts < length) & (counts > 0))
    out[short] = words.range_hashes(hashes, chunk.offsets[few], chunk.offsets[few + 1])
    for start, end in zip(ends - sizes, ends, strict=True):
        out[start:end].sort()
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[first], np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=chunk.rows))])


def _sketches(batches: Iterator[pa.RecordBatch], sketch: SetSketch, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in words.chunks(batch.column("text")):
            sets, offsets = shingle_sets(chunk, length)
            registers = sketch.draw(sets, offsets)
            lanes = [np.add.reduceat(np.append(words.mix(sets ^ np.uint64(k)), np.uint64(0)), offsets[:-1]) * (np.diff(offsets) > 0)
                     for k in (1, 2)] if chunk.rows else [np.empty(0, np.uint64)] * 2
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(chunk.row, chunk.rows), pa.array(np.diff(offsets)),
                pa.array(lanes[0].astype(np.uint64).view(np.int64)), pa.array(lanes[1].astype(np.uint64).view(np.int64)),
                pa.array([row.tobytes() for row in registers], pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "registers"])


def sketch_documents(docs: DataFrame, sketch: SetSketch = SetSketch(), length: int = 2) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, registers) for each row of docs(doc_id, text); f1 and f2 identify the whole set."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda batches: _sketches(batches, sketch, length),
                           "doc_id long, n_shingles long, f1 long, f2 long, registers binary")


def _bands(nodes: DataFrame, sketch: SetSketch) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                registers = np.array([np.frombuffer(r, np.uint16) for r in part.column("registers").to_pylist()])
                node = np.repeat(part.column("node").to_numpy(), sketch.bands)
                yield pa.RecordBatch.from_arrays([pa.array(sketch.band_keys(registers).reshape(-1)), pa.array(node)], ["band", "node"])

    return nodes.select("node", "registers").mapInArrow(keys, "band long, node long")


def _likely(pairs: DataFrame, nodes: DataFrame, sketch: SetSketch, at: float) -> DataFrame:
    """The pairs (a, b) whose registers do not speak clearly against a similarity of `at`, with the estimate."""
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                left, right = (np.array([np.frombuffer(r, np.uint16) for r in part.column(c).to_pylist()]) for c in ("ra", "rb"))
                similar, lost = sketch.joint(left, right, *(part.column(c).to_numpy().astype(float) for c in ("na", "nb")), at)
                rows = part.select(["a", "b"]).append_column("similar", pa.array(similar))
                yield rows.filter(pa.array(lost <= LIKELY))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(
        estimate, "a long, b long, similar double")


def full_sets(docs: DataFrame, ids: DataFrame, length: int) -> DataFrame:
    """(node, shingles) of the documents whose ids are asked for."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words.chunks(batch.column("text")):
                values, offsets = shingle_sets(chunk, length)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.row, chunk.rows), lists], ["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.join(ids.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(sets, "node long, shingles array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets meet 100 * intersection >= percent * union."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(
        100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _across(placed: DataFrame, docs: DataFrame, length: int, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket in placed(band, node, comp), at least one for each document and
    component it links to.

    Documents of a bucket meet in the arena of the component that most of them belong to. Those of other components (few)
    are compared with all of the arena, on full sets, in blocks: a large arena is cut into blocks of about ARENA documents,
    small ones are packed together. Only links leave a block.
    """
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("arena"), F.count("*").alias("comps")).where("comps > 1")
    inside = checkpoint(placed.join(main, "band").select("arena", "node", "comp").distinct())
    outer = F.col("comp") != F.col("arena")
    arenas = inside.groupBy("arena").agg(F.count("*").alias("every"), F.count_if(outer).alias("outside"))
    sets = full_sets(docs, inside.select("node").distinct(), length)
    rows = checkpoint(inside.join(arenas, "arena").join(sets, "node"))  # read three times below
    blocks = lambda n: F.ceil(F.col(n) / ARENA).cast("long")
    of = lambda n: F.pmod(F.xxhash64("node"), blocks(n))
    packs = max(1, (inside.count() + ARENA - 1) // ARENA)
    small = rows.where(F.col("every") <= ARENA).select(
        F.array(F.lit(-1).cast("long"), F.pmod(F.xxhash64("arena"), F.lit(packs)), F.lit(0).cast("long")).alias("pack"), "arena", outer.alias("left"), F.lit(True).alias("right"), "node", "comp", "shingles")
    large = rows.where(F.col("every") > ARENA)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(blocks(n), F.lit(1)) - 1))
    left = large.where(outer).withColumn("j", upto("every")).select(
        F.array("arena", of("outside"), "j").alias("pack"), "arena", F.lit(True).alias("left"), F.lit(False).alias("right"), "node", "comp", "shingles")
    right = large.where("outside > 0").withColumn("i", upto("outside")).select(
        F.array(F.col("arena"), F.col("i"), of("every")).alias("pack"), "arena", F.lit(False).alias("left"), F.lit(True).alias("right"), "node", "comp", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        arena, node, comp = (table.column(c).to_numpy() for c in ("arena", "node", "comp"))
        is_left, is_right = (table.column(c).to_numpy() for c in ("left", "right"))
        lists = table.column("shingles").combine_chunks()
        flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        links = [link for one in np.unique(arena[is_left]) for link in _block_links(
            np.flatnonzero(is_left & (arena == one)), np.flatnonzero(is_right & (arena == one)), flat, at, node, comp, percent)]
        return pa.table({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})

    return small.unionByName(left).unionByName(right).groupBy("pack").applyInArrow(compare, "a long, b long").distinct()


def _block_links(left: np.ndarray, right: np.ndarray, flat: np.ndarray, at: np.ndarray, node: np.ndarray, comp: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links of each left row with one row of every other component on the right; set i is flat[at[i]:at[i + 1]]."""
    sizes = np.diff(at)
    every = np.concatenate([flat[at[r] : at[r + 1]] for r in right])
    owner = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    for x in left:
        own = flat[at[x] : at[x + 1]]
        low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        many = high - low
        hits = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        shared = np.bincount(owner[hits], minlength=len(right))
        met = np.flatnonzero((100 * shared >= percent * (sizes[x] + sizes[right] - shared)) & (comp[right] != comp[x]))
        _, first = np.unique(comp[right[met]], return_index=True)
        yield from ((int(node[x]), int(node[right[m]])) for m in met[first])


def _ordered(a: str | Column, b: str | Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicates(docs: DataFrame, sketch: SetSketch = SetSketch(), length: int = 2, percent: int = 80) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text); other columns are ignored.

    Documents with 100 * |intersection| >= percent * |union| of their shingle sets are linked; component_id is the
    smallest doc_id that links reach, kept says doc_id = component_id. Null or blank texts have no shingles and no links.
    Rows that repeat a doc_id are one document. A null doc_id has a null component_id and is kept. No rows give no rows.

    A pair at the threshold shares no band with probability (1 - 0.8 ** band) ** bands, 2e-9 by default; a shared band
    always leads to the exact test or to a common component.
    """
    at = percent / 100
    drawn = checkpoint(sketch_documents(docs, sketch, length))
    filled = drawn.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = filled.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"))
    copies = filled.join(classes.where("last > node"), ["f1", "f2", "n_shingles"]).select("node", "doc_id")
    repeated = filled.groupBy("doc_id").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where("low != high").select("doc_id")
    copies = checkpoint(copies.where("doc_id != node").distinct())  # rows that repeat an id are one document
    nodes = filled.join(copies.join(repeated, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_anti").select(
        F.col("doc_id").alias("node"), "n_shingles", "registers")

    bands = _bands(nodes, sketch)
    masked = F.col("node").bitwiseXOR(F.col("band"))
    buckets = bands.groupBy("band").agg(F.min(masked).alias("low"), F.max(masked).alias("high")).where("low != high")
    members = checkpoint(bands.join(buckets.select("band", F.col("low").bitwiseXOR(F.col("band")).alias("pivot")), "band"))

    met = members.where("node != pivot").select(*_ordered("node", "pivot")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    likely = checkpoint(_likely(met.select("a", "b"), nodes, sketch, at))
    ids = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    sets = checkpoint(full_sets(docs, ids, length))
    best = likely.groupBy("b").agg(F.max_by("a", "similar").alias("a"))
    links = checkpoint(_linked(best.select("a", "b"), sets, percent))
    roots = components(links, "a", "b")

    def rooted(df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
        found = roots.select(F.col("node").alias(column), F.col("root").alias(name))
        return df.join(found, column, "left").withColumn(name, F.coalesce(name, column))

    rest = rooted(rooted(likely, roots, "a", "ca"), roots, "b", "cb").where("ca != cb").select("a", "b")
    more = checkpoint(_linked(rest, sets, percent))
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links, "a", "b")
    placed = rooted(members, roots, "node", "comp")
    last = checkpoint(_across(placed, docs, length, percent))
    if not last.isEmpty():
        links = links.unionByName(last)
        roots = components(links, "a", "b")

    joined = components(links.unionByName(copies.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))), "a", "b") \
        if not repeated.isEmpty() else None
    if joined is None:
        top = rooted(copies.select(F.col("doc_id").alias("copy"), "node"), roots, "node", "root").select(F.col("copy").alias("node"), "root")
        joined = roots.unionByName(top)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return drawn.select("doc_id", "n_shingles").join(joined.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")).withColumn("kept", kept)

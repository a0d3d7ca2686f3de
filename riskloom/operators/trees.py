"""Binned decision trees: a forest grown tree by tree, and second-order boosting on gradient histograms.

Both are fitted on all labelled rows, counted by the cells of the grid of cuts where there are many, and give a node table
and one way to score with it. Each tree of a forest draws its own bootstrap and weighs the classes of that bootstrap.
Boosting sums gradients and hessians by (node, feature, bin), level by level, and takes Newton steps; as each round needs
the one before, and a round on the counted cells takes well under a second, one task runs them all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.errors import ValidationError
from riskloom.operators.cells import count_cells, grid_cuts
from riskloom.operators.forests import NODE_NAMES as _NODE_NAMES, NODE_SCHEMA, TREE_SCHEMA, StoredForest, packed, stored_forest
from riskloom.operators.walk import Walk

_NODE_KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64())
#: Up to so many rows of the larger class, rows are gathered as they are; more are counted by cells.
_ONE_BY_ONE = 20_000
#: Nodes of a forest that every process may hold; larger forests stay in their table.
_HELD = 2_000_000


@dataclass(frozen=True)
class TreeEnsemble:
    """Node arrays of all trees. An inner node sends x[feature] <= threshold to `below`, others to the node after it; a
    leaf has feature -1. A forest averages leaf values, boosting adds them up to log-odds."""

    names: tuple[str, ...]
    kind: str
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    value: np.ndarray
    numClasses = 2

    @property
    def numFeatures(self) -> int:
        return len(self.names)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of x."""
        total = self._walk.total(x)
        return total / len(self.roots) if self.kind == "forest" else 1.0 / (1.0 + np.exp(-total))

    @cached_property
    def _walk(self) -> Walk:
        """The trees as rows are led down them; a worker that scores many batches keeps it."""
        return Walk(self.roots, self.feature, self.threshold, self.below, self.below + 1, self.value, missing_above=False)

    @cached_property
    def _shared(self):
        """The arrays as a broadcast variable: of rounds x 2 ** (depth + 1) nodes at most, or of a forest small enough to be held."""
        return SparkContext.getOrCreate().broadcast(self)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_shared", "_walk")}

    def probability(self, features: Sequence[Column]) -> Column:
        shared = self._shared

        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(shared.value.predict(np.column_stack([c.to_numpy(np.float64) for c in columns])))

        return F.pandas_udf(score, "double")(*[f.cast("double") for f in features])

    def node_frame(self, df: DataFrame) -> DataFrame:
        """The ensemble as a table, children numbered within their tree."""
        trees = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
        start = self.roots[trees]
        return df.sparkSession.createDataFrame(pd.DataFrame({
            "tree": trees.astype("int32"), "node": (np.arange(len(self.feature)) - start).astype("int32"), "feature": self.feature.astype("int32"),
            "threshold": self.threshold, "below": np.where(self.feature >= 0, self.below - start, -1).astype("int32"), "value": self.value}), NODE_SCHEMA)


def ensemble_from_nodes(nodes: pd.DataFrame, names: Sequence[str], kind: str) -> TreeEnsemble:
    """Lays the trees of a node table end to end."""
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
    sizes = nodes.groupby("tree", sort=True)["node"].size().to_numpy()
    roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    below = np.where(nodes["feature"].to_numpy() >= 0, nodes["below"].to_numpy(np.int64) + np.repeat(roots, sizes), -1)
    return TreeEnsemble(tuple(names), kind, roots, nodes["feature"].to_numpy(np.int16), nodes["threshold"].to_numpy(np.float64),
                        below.astype(np.int32), nodes["value"].to_numpy(np.float64))


def code_rows(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value: code <= b if and only if x <= cuts[b]."""
    return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.uint8)


def even_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 cuts halfway between values, all of them where there are few, else at even ranks."""
    distinct = np.unique(values)
    middles = (distinct[1:] + distinct[:-1]) / 2
    middles = np.where(middles < distinct[1:], middles, distinct[:-1])  # neighbouring doubles
    if len(middles) < bins:
        return middles
    ordered = np.sort(values)
    at = np.searchsorted(distinct, ordered[np.arange(1, bins) * len(ordered) // bins], side="left") - 1
    return middles[np.unique(at[at >= 0])]


# --- forest


def _totals(key: np.ndarray, weights: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order and the sums of each weight."""
    bits = len(key).bit_length()
    packed = np.sort(key << bits | np.arange(len(key)))  # a key and its row in one number sort faster than rows by key
    key, order = packed >> bits, packed & (1 << bits) - 1
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], [np.add.reduceat(w[order], first) for w in weights]


def _purity(left: Sequence[np.ndarray], right: Sequence[np.ndarray], least: int, scale: tuple[float, float]) -> np.ndarray:
    """What a split by Gini is worth, given (class 0, class 1, rows) on either side; -inf where a side has too few rows."""
    (la, lb, ln), (ra, rb, rn) = ((a * scale[0], b * scale[1], n) for a, b, n in (left, right))
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = (la * la + lb * lb) / (la + lb) + (ra * ra + rb * rb) / (ra + rb)
    return np.where((ln >= least) & (rn >= least), purity, -np.inf)


def _best_cuts(code: np.ndarray, node: np.ndarray, n_nodes: int, weights: Sequence[np.ndarray], least: int, scale: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(purity, code) of the best cut of one feature in every node, each of which has rows; a table of all codes where that is small."""
    bins = int(code.max()) + 1
    key = node * bins + code
    if n_nodes * bins <= 2 * len(code):
        left = [np.cumsum(np.bincount(key, weights=w, minlength=n_nodes * bins).reshape(n_nodes, bins), axis=1) for w in weights]
        purity = _purity(left, [part[:, -1:] - part for part in left], least, scale)
        cut = purity.argmax(axis=1)
        return purity[np.arange(n_nodes), cut], cut
    key, sums = _totals(key, weights)
    owner = key // bins
    start = np.searchsorted(owner, np.arange(n_nodes))
    end = np.append(start[1:], len(owner))
    left, right = [], []
    for part in sums:
        running = np.concatenate([[0.0], np.cumsum(part)])
        left.append(running[1:] - running[start][owner])
        right.append(running[end][owner] - running[1:])
    purity = _purity(left, right, least, scale)
    top = np.maximum.reduceat(purity, start)
    place = np.flatnonzero(purity == top[owner])
    return top, key[place[np.searchsorted(owner[place], np.arange(n_nodes))]] % bins


def _best_splits(codes: np.ndarray, node: np.ndarray, n_nodes: int, w0: np.ndarray, w1: np.ndarray, rows: np.ndarray, least: int, drawn: np.ndarray,
                 scale: tuple[float, float] = (1.0, 1.0)):
    """(feature, bin) of the best Gini split of every node, feature -1 where none splits; features not drawn only count where no
    drawn one splits. The classes weigh by `scale`: sums of whole numbers do not depend on the order of addition."""
    feature, cut = np.full(n_nodes, -1), np.zeros(n_nodes, np.int64)
    for wanted in (drawn, ~drawn):
        best, undecided = np.full(n_nodes, -np.inf), feature < 0
        for j in range(codes.shape[1]):
            which = np.flatnonzero(wanted[:, j] & undecided)
            if not len(which):
                continue
            at, inside = slice(None), node
            if len(which) < n_nodes:
                number = np.full(n_nodes, -1)
                number[which] = np.arange(len(which))
                inside = number[node]
                at = np.flatnonzero(inside >= 0)
                inside = inside[at]
            top, found = _best_cuts(codes[at, j], inside, len(which), (w0[at], w1[at], rows[at]), least, scale)
            better = top > best[which]
            best[which[better]], feature[which[better]], cut[which[better]] = top[better], j, found[better]
    return feature, cut


def grow_tree(codes: np.ndarray, label: np.ndarray, copies: np.ndarray, cuts: Sequence[np.ndarray], *, depth: int, least: int,
              share: float, tries: int, random: np.random.Generator) -> list[tuple]:
    """(node, feature, threshold, below, value) of one tree on a bootstrap of `share` of the rows; a row stands for its copies.

    Both classes of the bootstrap weigh alike in all. Nodes are numbered level by level, the two children of a node in a row.
    """
    draws = random.multinomial(max(1, round(share * copies.sum())), copies / copies.sum())
    used = np.flatnonzero(draws)
    codes, label, draws = codes[used], label[used], draws[used]
    start = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]).any(axis=1)]))  # neighbours of equal codes are one row
    codes = codes[start]
    w0, w1, rows = (np.add.reduceat(w.astype(float), start) for w in (draws * (label == 0), draws * (label == 1), np.minimum(draws, copies[used])))
    n0, n1 = w0.sum(), w1.sum()
    scale = (n0 + n1) / (2 * max(n0, 1)), (n0 + n1) / (2 * max(n1, 1))
    out: list[tuple] = []
    node, first, count = np.zeros(len(codes), np.int64), 0, 1
    for level in range(depth + 1):
        a, b, n = (np.bincount(node, weights=w, minlength=count) * k for w, k in ((w0, scale[0]), (w1, scale[1]), (rows, 1.0)))
        value = b / np.maximum(a + b, 1e-300)
        splits = (n >= 2 * least) & (a > 0) & (b > 0) if level < depth else np.zeros(count, bool)
        feature, cut = np.full(count, -1), np.zeros(count, np.int64)
        if splits.any():
            number = np.cumsum(splits) - 1
            at = np.flatnonzero(splits[node])
            m = codes.shape[1]
            drawn = np.argsort(random.random((int(splits.sum()), m)), axis=1) < tries
            feature[splits], cut[splits] = _best_splits(codes[at], number[node[at]], int(splits.sum()), w0[at], w1[at], rows[at], least, drawn, scale)
        inner = feature >= 0
        below = first + count + 2 * (np.cumsum(inner) - 1)
        out += [(first + i, int(feature[i]), float(cuts[feature[i]][cut[i]]) if inner[i] else 0.0, int(below[i]) if inner[i] else -1, float(value[i])) for i in range(count)]
        if not inner.any():
            break
        moving = np.flatnonzero(inner[node])
        node = node[moving]
        node = below[node] - first - count + (codes[moving, feature[node]] > cut[node])
        bits = len(node).bit_length()
        packed = np.sort(node << bits | np.arange(len(node)))  # rows of a node lie together
        node, moving = packed >> bits, moving[packed & (1 << bits) - 1]
        codes, w0, w1, rows = codes[moving], w0[moving], w1[moving], rows[moving]
        first, count = first + count, 2 * int(inner.sum())
    return out


def _drawn_rows(rows: DataFrame, counts: dict[int, int], rows_per_class: int, seed: int) -> DataFrame:
    """About `rows_per_class` rows of each class, chosen by a digest of the row, for a caller who asks for no more."""
    share = F.when(F.col("label") == 1, min(1.0, rows_per_class / counts[1])).otherwise(min(1.0, rows_per_class / counts[0]))
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "x", "label"), F.lit(1 << 32)) < share * (1 << 32))


def _distinct_rows(rows: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, label, copies) of all of a few rows, ordered by a digest of the row; equal rows come as one, combined before the shuffle."""
    found = rows.withColumn("digest", F.xxhash64(F.lit(seed), "x", "label")).groupBy("digest", "label", "x").agg(F.count("*").alias("copies")).toPandas()
    found["x"] = found["x"].map(tuple)
    found = found.sort_values(["digest", "label", "x"])
    return np.array(found["x"].tolist(), np.float64), found["label"].to_numpy(np.int64), found["copies"].to_numpy(np.int64)


def _coded_rows(rows: DataFrame, counts: dict[int, int], features: int, rows_per_class: int | None, bins: int,
                seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(codes, label, copies, cuts) of all rows, or of about `rows_per_class` of each class where a caller asks for that."""
    if rows_per_class is not None:
        rows = _drawn_rows(rows, counts, rows_per_class, seed)
    elif max(counts.values()) > _ONE_BY_ONE:
        cuts = grid_cuts(rows, features, sum(counts.values()), bins)
        return *count_cells(rows, cuts), cuts
    x, label, copies = _distinct_rows(rows, seed)
    cuts = [even_cuts(x[:, j], bins) for j in range(features)]
    return code_rows(x, cuts), label, copies, cuts


def fit_forest(rows: DataFrame, counts: dict[int, int], names: Sequence[str], *, trees: int, depth: int, least: int, share: float,
               bins: int, seed: int, rows_per_class: int | None = None) -> TreeEnsemble | StoredForest:
    """Random forest on all rows(x array<double>, label int); `tries` is the square root of the features, as usual.

    With `rows_per_class`, about so many of a class are used. Classes are balanced within each bootstrap. Two fits of equal
    rows are equal. Trees go to a table; a forest of more than two million nodes stays there.
    """
    if trees < 1 or depth < 1 or least < 1 or not 0 < share <= 1 or not 2 <= bins <= 256 or (rows_per_class is not None and rows_per_class < 1):
        raise ValidationError("forest settings out of range")
    codes, label, copies, cuts = _coded_rows(rows, counts, len(names), rows_per_class, bins, seed)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((codes, label, copies, cuts))
    tries = max(1, int(np.sqrt(len(names))))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                nodes = grow_tree(*shared.value, depth=depth, least=least, share=share, tries=tries, random=np.random.default_rng([seed, tree]))
                _, feature, threshold, below, value = (np.array(c) for c in zip(*nodes, strict=True))
                yield packed(tree, feature, threshold, below, value, cuts)

    tasks = spark.range(0, trees, 1, min(trees, 4 * spark.sparkContext.defaultParallelism))
    forest = stored_forest(tasks.mapInArrow(grow, TREE_SCHEMA), names, cuts, trees)
    if forest.table.agg(F.sum("nodes")).first()[0] > _HELD:
        return forest
    return ensemble_from_nodes(forest.node_frame(rows).toPandas(), names, "forest")


# --- boosting


def leaf_weight(gradient: np.ndarray, hessian: np.ndarray, penalty: float, most: float) -> np.ndarray:
    """Newton step of a node, held within `most` where that is above nought."""
    step = -gradient / (hessian + penalty)
    return np.clip(step, -most, most) if most else step


def node_gain(gradient: np.ndarray, hessian: np.ndarray, penalty: float, most: float) -> np.ndarray:
    """Loss that the node's own step takes away, twice."""
    step = leaf_weight(gradient, hessian, penalty, most)
    return -(2 * gradient * step + (hessian + penalty) * step * step)


def boost(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, copies: np.ndarray, cuts: Sequence[np.ndarray], *, rounds: int,
          depth: int, rate: float, share: float, columns: float, most: float, penalty: float, least: float, seed: int) -> list[tuple]:
    """(tree, node, feature, threshold, below, value) of all rounds; a row stands for its copies, each of the given weight.

    Odds start even. Splits and steps use the sampled rows and columns of a round; the margins of all rows follow.
    """
    n, m = codes.shape
    bins = max((len(c) for c in cuts), default=0) + 1
    by_feature = np.ascontiguousarray(codes.T)
    margin = np.zeros(n)
    out: list[tuple] = []
    for tree in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        random = np.random.default_rng([seed, tree])
        used = np.sort(random.choice(m, max(1, int(columns * m)), replace=False))
        drawn = random.binomial(copies, share)
        sampled = np.flatnonzero(drawn)
        gradient, hessian = (drawn * weight * (p - label))[sampled], (drawn * weight * p * (1 - p))[sampled]
        node, first, count = np.zeros(n, np.int64), 0, 1
        totals = None
        for level in range(depth + 1):
            if level < depth:
                inside = node[sampled]
                live = np.flatnonzero(inside >= 0)
                rows, weights, start = sampled[live], (gradient[live], hessian[live]), inside[live] * bins
                sums = np.zeros((len(used), 2, count, bins))
                for i, j in enumerate(used):
                    at = start + by_feature[j][rows]
                    for k, values in enumerate(weights):
                        sums[i, k] = np.bincount(at, weights=values, minlength=count * bins).reshape(count, bins)
                if totals is None:
                    totals = sums[0].sum(axis=2)
                left = np.cumsum(sums, axis=3)
                right = totals[None, :, :, None] - left
                gain = node_gain(left[:, 0], left[:, 1], penalty, most) + node_gain(right[:, 0], right[:, 1], penalty, most)
                gain = gain - node_gain(totals[0], totals[1], penalty, most)[None, :, None]
                allowed = (left[:, 1] >= least) & (right[:, 1] >= least)
                for i, j in enumerate(used):
                    allowed[i, :, len(cuts[j]) :] = False
                gain = np.where(allowed, gain, -np.inf).transpose(1, 0, 2).reshape(count, -1)
                best = gain.argmax(axis=1)
                inner = gain[np.arange(count), best] > 1e-6
                which, cut = best // bins, best % bins
            else:
                inner = np.zeros(count, bool)
            below = first + count + 2 * (np.cumsum(inner) - 1)
            values = rate * leaf_weight(totals[0], totals[1], penalty, most)
            out += [(tree, first + i, int(used[which[i]]), float(cuts[used[which[i]]][cut[i]]), int(below[i]), float(values[i])) if inner[i]
                    else (tree, first + i, -1, 0.0, -1, float(values[i])) for i in range(count)]
            here = np.flatnonzero(node >= 0)
            leaf = here[~inner[node[here]]]
            margin[leaf] += values[node[leaf]]
            if not inner.any():
                break
            going = here[inner[node[here]]]
            at = node[going]
            moved = np.full(n, -1, np.int64)
            moved[going] = below[at] - first - count + (by_feature.take(used[which[at]] * n + going) > cut[at])
            split = np.flatnonzero(inner)
            pair = np.stack([left[which[split], :, split, cut[split]], right[which[split], :, split, cut[split]]], axis=1)
            totals = pair.reshape(-1, 2).T
            node, first, count = moved, first + count, 2 * len(split)
    return out


def fit_boosting(rows: DataFrame, counts: dict[int, int], names: Sequence[str], *, rounds: int, depth: int, rate: float, share: float,
                 columns: float, most: float, penalty: float, least: float, bins: int, seed: int, rows_per_class: int | None = None) -> TreeEnsemble:
    """Second-order boosting on all rows(x array<double>, label int); with `rows_per_class`, on about so many of a class.

    Positives weigh negatives / positives. Rows drawn for `rows_per_class` weigh as much as those they stand for, so sums of
    hessians have the size they would have on all rows. Two fits of equal rows are equal.
    """
    if rounds < 1 or depth < 1 or not 0 < share <= 1 or not 0 < columns <= 1 or not 2 <= bins <= 256 or (rows_per_class is not None and rows_per_class < 1):
        raise ValidationError("boosting settings out of range")
    codes, label, copies, cuts = _coded_rows(rows, counts, len(names), rows_per_class, bins, seed)
    weight = np.array([counts[0] / max(1, copies[label == k].sum()) for k in (0, 1)])[label]
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((codes, label, weight, copies, cuts))
    settings = {"rounds": rounds, "depth": depth, "rate": rate, "share": share, "columns": columns, "most": most, "penalty": penalty, "least": least, "seed": seed}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            nodes = boost(*shared.value, **settings)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*nodes, strict=True), _NODE_KINDS, strict=True)], _NODE_NAMES)

    nodes = spark.range(1, numPartitions=1).mapInArrow(run, NODE_SCHEMA).toPandas()  # rounds x 2 ** (depth + 1) rows at most
    return ensemble_from_nodes(nodes, names, "boosting")

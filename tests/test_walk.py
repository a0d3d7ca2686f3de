"""Sums of leaves against a plain walk, in each of the three ways, and how much is walked."""

import numpy as np
import pandas as pd
import pytest

from riskloom.operators import iforest, trees, walk


def isolation(features):
    random = np.random.default_rng(1)
    grow = iforest._grower(42, 6)
    grown = [grow(pd.DataFrame({"tree": t, "place": range(64), "x": list(random.normal(size=(64, features)))})) for t in range(9)]
    return iforest.forest_from_nodes(pd.concat(grown), [f"f{i}" for i in range(features)], 64)


def forest(values):
    random = np.random.default_rng(2)
    x = np.column_stack([random.integers(0, values, 600), random.integers(0, 12, 600), random.integers(0, 5, 600)]).astype(float)
    cuts = [trees.even_cuts(x[:, j], 256) for j in range(3)]
    label, copies = random.integers(0, 2, 600), np.ones(600, np.int64)
    rows = [(t, *n) for t in range(7) for n in trees.grow_tree(trees.code_rows(x, cuts), label, copies, cuts, depth=20, least=1, share=0.8, tries=2, random=np.random.default_rng(t))]
    return trees.ensemble_from_nodes(pd.DataFrame(rows, columns=trees._NODE_NAMES), ["a", "b", "c"], "forest")


def plain(roots, feature, threshold, below, above, value, missing_above, rows):
    out = []
    for x in rows:
        total = 0.0
        for root in roots:
            at = root
            while feature[at] >= 0:
                v = x[feature[at]]
                at = above[at] if (missing_above if np.isnan(v) else v > threshold[at]) else below[at]
            total += value[at]
        out.append(total)
    return np.array(out)


def odd_rows(features, scale):
    rows = np.random.default_rng(3).normal(size=(400, features)) * scale
    rows[0], rows[1, 0], rows[2, 1], rows[3, -1] = np.nan, np.inf, -np.inf, np.nan
    return rows


@pytest.mark.parametrize("features, after", [(3, 0), (3, 10**9), (12, 0)])
def test_isolation_paths_equal_a_plain_walk(monkeypatch, features, after):
    monkeypatch.setattr(walk, "_AFTER", after)
    monkeypatch.setattr(walk, "_CELLS", 0)
    found, rows = isolation(features), odd_rows(features, 2)
    parts = found.roots, found.feature, found.threshold, found.below, found.above, found.path
    assert found._walk.total(rows).tolist() == plain(*parts, True, rows).tolist()


@pytest.mark.parametrize("tree", [1 << 16, 200, 0])
def test_some_trees_may_be_too_large_for_tables(monkeypatch, tree):
    monkeypatch.setattr(walk, "_AFTER", 0)
    monkeypatch.setattr(walk, "_CELLS", 0)
    monkeypatch.setattr(walk, "_TREE", tree)
    found, rows = isolation(2), odd_rows(2, 2)
    parts = found.roots, found.feature, found.threshold, found.below, found.above, found.path
    assert found._walk.total(rows).tolist() == plain(*parts, True, rows).tolist()


@pytest.mark.parametrize("cells", [0, 1 << 22])
def test_forest_leaves_equal_a_plain_walk(monkeypatch, cells):
    monkeypatch.setattr(walk, "_CELLS", cells)
    found, rows = forest(30), odd_rows(3, 9)
    parts = found.roots, found.feature, found.threshold, found.below, found.below + 1, found.value
    assert (found.predict(rows) * 7).tolist() == pytest.approx(plain(*parts, False, rows).tolist())
    assert found._walk.total(rows).tolist() == plain(*parts, False, rows).tolist()
    assert found.predict(rows[:0]).tolist() == []


def test_a_cell_is_walked_once(monkeypatch):
    walked = []
    reached = walk.Walk._reached
    monkeypatch.setattr(walk.Walk, "_reached", lambda self, codes, root: walked.append(codes.shape[1]) or reached(self, codes, root))
    found = forest(8)
    rows = np.random.default_rng(4).integers(0, 9, (50_000, 3)).astype(float)
    first = found.predict(rows)
    most = 7 * found._walk.cells.size
    assert 0 < sum(walked) <= most < len(rows)
    walked.clear()
    assert (found.predict(rows) == first).all() and not walked


def test_a_lone_leaf():
    found = trees.TreeEnsemble(("a",), "forest", np.array([0]), np.array([-1], np.int16), np.array([0.0]), np.array([-1], np.int32), np.array([0.25]))
    assert found.predict(np.array([[1.0], [np.nan]])).tolist() == [0.25, 0.25]

"""The additive model against sums, trees and boosting steps worked out one by one."""

import itertools
import math

import numpy as np
import pytest

from scoregate.llm import gam


def data(seed, n=200, columns=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, columns)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=n) > 0).astype(float)
    return x, y


def test_score_is_the_sum_of_intercept_tables_and_pairs():
    x, y = data(1)
    model = gam.fit_arrays(x, y)
    assert model.pairs and model.tables
    got = model.score(x)
    for row, p in zip(x, got, strict=True):
        bins = [sum(1 for e in edges if e < v) for v, edges in zip(row, model.edges, strict=True)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[bins[i]][bins[j]] for i, j, t in model.pairs)
        assert math.isclose(p, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def gain(rows, g, h):
    return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + gam.PENALTY)


def tree_by_hand(bins, g, h, width):
    """The best cut of all, again and again, by trying each one with its sums taken anew."""
    leaves = [(0, width)]
    inside = lambda a, b: [i for i in range(len(bins)) if a <= bins[i] < b]
    while len(leaves) < gam.LEAVES:
        found = []
        for a, b in leaves:
            for cut in range(a + 1, b):
                left, right = inside(a, cut), inside(cut, b)
                if min(sum(h[i] for i in left), sum(h[i] for i in right)) >= gam.MIN_HESSIAN:
                    found.append((gain(left, g, h) + gain(right, g, h) - gain(left + right, g, h), (a, b), cut))
        if not found or max(f[0] for f in found) <= 1e-9:
            break
        _, (a, b), cut = max(found, key=lambda f: f[0])
        leaves.remove((a, b))
        leaves += [(a, cut), (cut, b)]
    step = [0.0] * width
    for a, b in leaves:
        own = inside(a, b)
        for k in range(a, b):
            step[k] = -sum(g[i] for i in own) / (sum(h[i] for i in own) + gam.PENALTY)
    return step


@pytest.mark.parametrize("seed", range(3))
def test_a_round_of_boosting(monkeypatch, seed):
    monkeypatch.setattr(gam, "ROUNDS", 1)
    monkeypatch.setattr(gam, "PAIR_ROUNDS", 0)
    monkeypatch.setattr(gam, "BINS", 8)
    x, y = data(seed)
    model = gam.fit_arrays(x, y)
    f = np.full(len(y), model.intercept)
    share = (y.sum() + 1) / (len(y) + 2)
    assert math.isclose(model.intercept, math.log(share / (1 - share)))
    bins = model.bins(x)
    for j in range(x.shape[1]):  # cyclic: each feature sees what those before it did
        p = 1 / (1 + np.exp(-f))
        want = gam.RATE * np.array(tree_by_hand(bins[:, j], p - y, p * (1 - p), len(model.edges[j]) + 1))
        np.testing.assert_allclose(model.tables[j], want, atol=1e-9)
        f += want[bins[:, j]]


@pytest.mark.parametrize("seed", range(5))
def test_quadrants_by_trying_all_cuts(seed):
    rng = np.random.default_rng(seed)
    g, h = rng.normal(size=(5, 4)), rng.random((5, 4)) + 0.1
    best = None
    for i, j in itertools.product(range(1, 5), range(1, 4)):
        parts = [(slice(a, b), slice(c, d)) for a, b in ((0, i), (i, 5)) for c, d in ((0, j), (j, 4))]
        found = sum(g[p].sum() ** 2 / (h[p].sum() + gam.PENALTY) for p in parts) - g.sum() ** 2 / (h.sum() + gam.PENALTY)
        if best is None or found > best[0] + 1e-12:
            best = found, parts
    got, step = gam._quadrants(g, h)
    assert math.isclose(got, best[0], rel_tol=1e-9)
    for p in best[1]:
        np.testing.assert_allclose(step[p], -g[p].sum() / (h[p].sum() + gam.PENALTY))

"""Nearest neighbours by pivots: brute force, odd vectors, what is compared, and the plan."""

import numpy as np
import pytest

from scoregate.operators import pivots, vectors

SCHEMA = "item long, position int, patch array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(i, 0, None if r is None else [float(v) for v in r]) for i, r in enumerate(rows)], SCHEMA)


def clustered(rng, n, dim, centres):
    return centres[rng.integers(0, len(centres), n)] + rng.normal(scale=0.2, size=(n, dim))


def wanted(queries, bank):
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]
    return np.clip(1 - (unit(queries) @ unit(bank).T).max(1), 0, 2)


@pytest.mark.parametrize("piece_rows", [1 << 20, 700])
def test_a_large_bank_is_mostly_not_compared(spark, monkeypatch, piece_rows):
    """A third of the bank are copies of one vector, a piece may hold a part of a cluster."""
    monkeypatch.setattr(pivots, "PIECE_BYTES", piece_rows * 8 * 8)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8))
    n = 100_000 if piece_rows > 100_000 else 3_000
    bank, queries = clustered(rng, n, 8, centres), clustered(rng, 500, 8, centres)
    bank[: n // 3] = bank[0]
    got = {r["item"]: r for r in pivots.nearest_in_bank(frame(spark, queries), "item", frame(spark, bank)).collect()}
    assert len(got) == 500
    np.testing.assert_allclose([got[i]["distance"] for i in range(500)], wanted(queries, bank), atol=1e-12)
    share = sum(r["compared"] for r in got.values()) / (500 * n)
    assert share < (0.05 if n > 50_000 else 0.5), share


def test_vectors_without_any_order(spark):
    """Uniform directions in many dimensions prune nothing and stay right."""
    rng = np.random.default_rng(2)
    bank, queries = rng.normal(size=(900, 48)), rng.normal(size=(60, 48))
    got = {r["item"]: r["distance"] for r in pivots.nearest_in_bank(frame(spark, queries), "item", frame(spark, bank)).collect()}
    np.testing.assert_allclose([got[i] for i in range(60)], wanted(queries, bank), atol=1e-12)


def test_odd_vectors(spark):
    bank = [[1, 0], [0, 2], None, [1, 0]]
    queries = [[3, 0], [-1, -1], None, [0, 0], [1, 2, 3], [1, 0]]
    ask = lambda q, b: [r["distance"] for r in pivots.nearest_in_bank(frame(spark, q), "item", frame(spark, b)).orderBy("item").collect()]
    near = lambda got, want: all((g is None) == (w is None) and (g is None or abs(g - w) < 1e-9) for g, w in zip(got, want, strict=True))
    assert near(ask(queries, bank), [0, 1 + np.sqrt(0.5), None, 1, None, 0])
    assert near(ask(queries, [*bank, [0, 0]]), [0, 1, None, 1, None, 0])
    assert near(ask([[-1, 0], [0, 0]], [[0, 0]]), [1, 1])
    assert ask(queries, []) == [None] * 6 and ask([], bank) == []


def test_queries_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 10)
    rng = np.random.default_rng(3)
    out = vectors.nearest_distances(frame(spark, rng.normal(size=(40, 4))), "item", frame(spark, rng.normal(size=(200, 4))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert out.count() == 40

"""Lists of the embedding index: two levels of centres, several blocks, and what is compared of a large label."""

import numpy as np
import pytest

from scoregate.llm import embedding_dedup


def _planted(rng, groups, copies, size, spread):
    base = rng.normal(size=(groups, size))
    return np.repeat(base, copies, 0) + rng.normal(size=(groups * copies, size)) * spread


def _brute(rows):
    """n_links and component_id of (vec_id, vector, label) rows, all pairs in double precision."""
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    label = np.array([name for _, _, name in rows])
    linked = (x @ x.T >= embedding_dedup.COSINE) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    root = np.arange(len(rows))
    while True:
        least = np.minimum(root, np.where(linked, root[None], len(rows)).min(1))
        if (least == root).all():
            return {i: (int(n), int(r)) for i, (n, r) in enumerate(zip(linked.sum(1), root, strict=True))}
        root = least


@pytest.mark.parametrize(("per_list", "coarse", "block"), [(8, 4, 32), (16, 1024, 16), (500, 1024, 2048)])
def test_all_links_of_lists_in_two_levels(spark, monkeypatch, per_list, coarse, block):
    for name, value in {"PER_LIST": per_list, "COARSE": coarse, "BLOCK": block, "SUBSPACES": 4}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(3)
    x = np.concatenate([_planted(rng, 40, 5, 12, 0.08), rng.normal(size=(60, 12))])
    x = np.concatenate([x, x[:7]])
    rows = [(i, v.tolist(), "ab"[i % 3 == 0]) for i, v in enumerate(x)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    expected = _brute(rows)
    assert max(n for n, _ in expected.values()) > 2
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()} == expected


def test_lists_follow_a_label_and_most_of_it_is_not_compared(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "COARSE", 16)
    rng = np.random.default_rng(5)
    x = _planted(rng, 400, 500, 16, 0.05)
    x /= np.sqrt((x * x).sum(1))[:, None]
    index = embedding_dedup.Index(x[rng.permutation(len(x))[:4000]], len(x) // embedding_dedup.PER_LIST)
    assert len(index.coarse) == 16 and len(index.fine) == 25
    some = x[::100]
    listed = index.encode(x)[0]
    held = np.bincount(listed, minlength=len(index.coarse) * len(index.fine))
    radius = float(np.sqrt(2 - 2 * embedding_dedup.COSINE))
    row, probed, _ = (np.concatenate(c) for c in zip(*index.probes(some, radius), strict=True))
    share = held[probed].sum() / (len(some) * len(x))
    assert share < 0.25, share
    asked = set(zip(row.tolist(), probed.tolist(), strict=True))
    for i in range(0, len(some), 50):
        assert all((i, at) in asked for at in listed[x @ some[i] >= embedding_dedup.COSINE].tolist())

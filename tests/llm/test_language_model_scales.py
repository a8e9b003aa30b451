"""The language model is better than its base at every size of shard, and beside one long document."""

import os

import numpy as np
import pytest

from scoregate.llm import language_model as lm
from scoregate.llm import queries


def gain(rows):
    """Log10 units a token by which held-out texts are likelier than under the base."""
    held = [r for r in rows if r["held_out"]]
    return (sum(r["score"] for r in held) - sum(r["base_score"] for r in held)) / sum(r["n_tokens"] for r in held)


@pytest.mark.parametrize("size,shard_tokens,floor", [("sf0.001", 4_000_000, 0.05), ("sf0.01", 4_000_000, 0.08), ("sf0.01", 50_000, 0.02)])
def test_held_out_gain(spark, monkeypatch, size, shard_tokens, floor):
    folder = f"/root/testdata/{size}"
    if not os.path.isdir(folder):
        pytest.skip(f"no tables in {folder}")
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard_tokens)
    found = gain(lm.language_scores(queries.table(spark, folder, "documents")).select("held_out", "n_tokens", "base_score", "score").collect())
    assert found > floor, found


def test_a_long_document_among_short_ones(spark):
    rng = np.random.default_rng(3)
    follow = rng.integers(0, 60, (60, 4))

    def text(n):
        out, at = [], int(rng.integers(60))
        for _ in range(n):
            out.append(f"w{at}")
            at = int(follow[at, rng.integers(4)])
        return " ".join(out)

    rows = [(i, text(40)) for i in range(400)] + [(1000, text(20_000))]
    found = gain(lm.language_scores(spark.createDataFrame(rows, "doc_id long, text string")).select("held_out", "n_tokens", "base_score", "score").collect())
    assert found > 0.0, found

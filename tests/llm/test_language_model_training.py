"""The language model's training: gradients by differences, scores by hand, and no dependence on partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoregate.llm import language_model as lm
from scoregate.llm import queries


def _tiny():
    tokens = np.array([3, 5, 7, 9, 11, lm.END], np.uint64)
    return lm.Vocabulary(tokens, np.array([9, 7, 5, 3, 1, 6]), 40, 9)


def _loss(net, inputs, targets, used):
    net.ready()
    hs = net.states(inputs, np.zeros((inputs.shape[1], lm.HIDDEN), np.float32))
    return -float(net.log_likelihoods(hs.reshape(-1, lm.HIDDEN)[used.ravel()], targets[used]).astype(np.float64).sum())


def test_window_follows_the_gradient():
    """What a window adds to Adagrad's sums is the square of the loss's slope, told by differences of the loss."""
    v, rng = _tiny(), np.random.default_rng(1)
    inputs, targets = rng.integers(0, v.words + 1, (6, 3)), rng.integers(0, v.words + 1, (6, 3))
    inputs[0], inputs[3, 1] = v.start, v.start
    used = np.ones((6, 3), bool)
    used[4:, 2] = False
    net = lm.Network(v)
    for name in ("wc", "wo"):
        getattr(net, name)[:] = rng.normal(0, 0.3, getattr(net, name).shape)
    start = net.flat()
    trainer = lm.Trainer(net)
    trainer.window(inputs, targets, used, np.zeros((3, lm.HIDDEN), np.float32))
    scale, at = lm.SCALE / used.sum(), 0
    for name in lm.Network.NAMES:
        size = getattr(net, name).size
        past = trainer.past[name].ravel() - 1e-2
        for k in np.argsort(-past)[:4]:
            slopes = []
            for step in (2e-2, -2e-2):
                moved = start.copy()
                moved[at + k] += step
                slopes.append(_loss(lm.Network(v).load(moved), inputs, targets, used))
            assert math.isclose(min(abs(slopes[0] - slopes[1]) / 4e-2 * scale, lm.CLIP), math.sqrt(max(past[k], 0)), rel_tol=0.05, abs_tol=0.1), (name, k)
        at += size


def test_score_by_hand():
    """Gates, class softmax, word softmax and the tail worked out token by token with plain floats."""
    v, rng = _tiny(), np.random.default_rng(2)
    net = lm.Network(v)
    net.load((net.flat() + rng.normal(0, 0.2, net.flat().size)).astype(np.float32)).ready()
    numbers = rng.integers(0, v.words + 1, 12)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, before, want, n = np.zeros(lm.HIDDEN), net.start, 0.0, lm.HIDDEN
    for token in numbers:
        x, g = net.embed[before].astype(float) @ net.wx + net.b, h @ net.wh
        r, z = sigmoid(x[:n] + g[:n]), sigmoid(x[n : 2 * n] + g[n : 2 * n])
        new = np.tanh(x[2 * n :] + r * g[2 * n :])
        h = (1 - z) * new + z * h
        classes = np.exp(h @ net.wc + net.bc)
        klass = net.classes if token == net.tail else token // lm.CLASS_WORDS
        want += math.log(classes[klass] / classes.sum())
        if token != net.tail:
            inside = np.exp(h @ net.wo[klass] + net.bo[klass])
            want += math.log(inside[token % lm.CLASS_WORDS] / inside.sum())
        before = token
    got = sum(
        float(net.log_likelihoods(net.states(i, s).reshape(-1, lm.HIDDEN)[u.ravel()], t[u]).sum())
        for i, t, u, s in ((i, t, o >= 0, np.zeros((live, lm.HIDDEN), np.float32)) for i, t, o, live in lm.windows([numbers], net.start, 1, 64))
    )
    assert math.isclose(got, want, rel_tol=1e-4)


@pytest.mark.parametrize("shard_tokens", [4_000_000, 8_000])
def test_scores_do_not_depend_on_partitions_and_beat_the_base(spark, sf_dir, monkeypatch, shard_tokens):
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard_tokens)
    docs = queries.table(spark, sf_dir, "documents")
    runs = []
    for parts in (1, 8, 64):
        rows = lm.language_scores(docs.repartition(parts, F.xxhash64("text"))).select("doc_id", "held_out", "n_tokens", "base_score", "score").collect()
        runs.append({r["doc_id"]: r for r in rows})
        held = [r for r in rows if r["held_out"]]
        gain = (sum(r["score"] for r in held) - sum(r["base_score"] for r in held)) / sum(r["n_tokens"] for r in held)
        assert gain > 0.02, gain  # log10 units a token
    for other in runs[1:]:
        assert all(math.isclose(r["score"], other[i]["score"], rel_tol=1e-3) for i, r in runs[0].items())

"""Training and scoring work in the same memory from window to window, and what is cut into blocks comes out as without."""

import resource

import numpy as np
import pyarrow as pa
import pytest

from scoregate.llm import common
from scoregate.llm import language_model as lm


def _made(words, seed=1):
    rng = np.random.default_rng(seed)
    tokens = np.append(np.arange(1, words, dtype=np.uint64), lm.END)
    v = lm.Vocabulary(tokens, rng.integers(1, 1000, words), 10**6, 2 * words)
    return v, rng


def _faults(step, windows):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for w in windows:
        step(*w)
    return (resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / len(windows)


def test_windows_do_not_page_in_fresh_memory():
    v, rng = _made(lm.MODEL_WORDS)
    trainer = lm.Trainer(lm.Network(v))
    h = np.zeros((lm.LANES, lm.HIDDEN), np.float32)
    windows = [tuple(rng.integers(0, v.words + 1, (2, lm.WINDOW, lm.LANES)).astype(lm.NUMBER)) for _ in range(40)]
    learn = lambda inputs, targets: trainer.window(inputs, targets, np.ones(inputs.shape, bool), h)
    _faults(learn, windows[:10])
    assert _faults(learn, windows[10:]) < 100  # before: 700


def test_states_and_likelihoods_of_one_window_after_another():
    v, rng = _made(200)
    net = lm.Network(v)
    net.load((net.flat() + rng.normal(0, 0.2, net.flat().size)).astype(np.float32))
    h = np.zeros((3, lm.HIDDEN), np.float32)
    numbers = rng.integers(0, v.words + 1, (12, 3)).astype(lm.NUMBER)
    whole = net.states(numbers, h).copy()
    first = net.states(numbers[:5], h).copy()
    second = net.states(numbers[5:], first[-1]).copy()
    assert np.allclose(np.concatenate([first, second]), whole, atol=1e-6)
    carried = net.states(numbers[:5], h)[-1]  # a view of what the next call writes to
    assert np.allclose(net.states(numbers[5:], carried), second, atol=1e-6)


@pytest.mark.parametrize("rows,scale", [(1024, 1.0), (7, 1.0), (7, 400.0)])
def test_blocks_across_classes(monkeypatch, rows, scale):
    v, rng = _made(300)
    net = lm.Network(v)
    net.load((net.flat() + rng.normal(0, 0.2, net.flat().size)).astype(np.float32))
    h = (scale * rng.normal(0, 1, (4, 30, lm.HIDDEN))).astype(np.float32)
    targets = rng.integers(0, v.words + 1, h.shape[:2])
    at = np.flatnonzero(rng.random(targets.size) < 0.8)
    monkeypatch.setattr(lm, "ROWS", rows)
    got = net.log_likelihoods(h, targets.ravel()[at], at)

    def log_softmax(z):
        return z - z.max() - np.log(np.exp(z - z.max()).sum())

    for k, place in enumerate(at):
        state, target = h.reshape(-1, lm.HIDDEN)[place].astype(float), int(targets.ravel()[place])
        klass = net.classes if target == net.tail else target // lm.CLASS_WORDS
        want = log_softmax(state @ net.wc.astype(float) + net.bc)[klass]
        if target != net.tail:
            want += log_softmax(state @ net.wo[klass].astype(float) + net.bo[klass])[target % lm.CLASS_WORDS]
        assert abs(got[k] - want) < 1e-4 * max(1, abs(want)), (k, got[k], want)


@pytest.mark.parametrize("lanes,steps", [(1, 4), (3, 5), (8, 50)])
def test_windows_hold_every_word_once(lanes, steps):
    rng = np.random.default_rng(lanes)
    docs = [rng.integers(0, 50, n).astype(lm.NUMBER) for n in (90, 1, *rng.integers(1, 20, 15))]
    said, heard, before = [[] for _ in docs], [[] for _ in docs], lanes
    for inputs, targets, owner, live in lm.windows(docs, 51, lanes, steps):
        assert inputs.shape == targets.shape == owner.shape and live == inputs.shape[1] <= before
        assert (inputs[owner < 0] == 51).all() and (targets[owner < 0] == 0).all()
        before = live
        for d in range(len(docs)):
            mine = owner.T == d
            said[d] += targets.T[mine].tolist()
            heard[d] += inputs.T[mine].tolist()
    for d, doc in enumerate(docs):
        assert said[d] == doc.tolist() and heard[d] == [51, *doc[:-1].tolist()]
    assert not list(lm.windows([], 51, lanes, steps))


def test_word_hashes_by_hand():
    texts = ["", " a\tb ", "x" * 70 + " y", "\x0b\x0c\r\n", "q\x08r\x0es \x00 \x1f!", "é ü  ", "end"]
    column = pa.array(texts)
    for _, _, raw, at in common.text_chunks(column):
        h, bounds = common.word_hashes(raw, at)
        for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            words = [w for w in bytes(text, "utf-8").translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
            assert len(words) == b - a
            for word, got in zip(words, h[a:b].tolist(), strict=True):
                if len(word) <= 64:
                    want = sum(int(common._RANDOM[k * 256 + c]) for k, c in enumerate(word)) % 2**64
                else:
                    want = common.xxhash.xxh3_64_intdigest(word)
                assert got == want

"""Language-model scoring with a gated recurrent network, beside an add-one unigram base.

Method: a GRU reads each document word by word and ends with an end token. Its output softmax is factored by classes: the
MODEL_WORDS most frequent training tokens stand in classes of CLASS_WORDS by rank, each with its own softmax; all other
tokens share one class, in which a token's share is (c + 1) / (sum of c + 1, and one for the unknown), c being its count in
training. Output biases start at the counts, so training starts from the unigram model. Training is truncated
backpropagation in numpy over windows of WINDOW steps on LANES lanes, the state carried on. A seeded hash deals all training
documents to ROUNDS rounds, so that each is learned from once, and in a round to shards of about SHARD_TOKENS tokens (or, from
MOST_SHARDS shards on, to as many larger ones). The shards of a round train from the same weights, each on its documents in
the order of the hash, and their weights are averaged, weighted by their tokens. Neither shards nor order depend on how the
input is partitioned, so the scores don't. Scoring carries the state across windows too, so that a document's log-likelihood
covers it whole, however long.

Counts cover all training documents. Only the KNOWN most frequent counts are broadcast (16 bytes each); the counts of all
other tokens meet the documents in a join. Tokens are known by 64-bit hashes.

Defined cases: a null or empty text is the end token alone; a null doc_id is never held out; without training documents
every count is 0 and the model is the untrained one; repeated rows stay (and count twice in training); further columns
are ignored; empty tables give empty results."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scoregate.llm.common import Scratch, ship, slices, text_chunks, word_hashes

MODEL_WORDS, CLASS_WORDS, KNOWN = 4096, 64, 1 << 17
EMBED, HIDDEN = 24, 32
WINDOW, LANES, SCORE_WINDOW, SCORE_LANES = 20, 64, 64, 256
#: The step size, which falls as 1 / sqrt(1 + windows / DECAY) beside Adagrad's own fall; the mean of a window's gradients is taken
#: SCALE times.
ROUNDS, RATE, DECAY, SCALE, CLIP = 2, 0.15, 100, 32, 8.0
SHARD_TOKENS, MOST_SHARDS = 4_000_000, 4096
#: Words trained on together or looked up together, words scored together, and words counted at a time. A long document goes on
#: alone where the others of its lanes have ended, so that it is scored beside as many as memory allows.
CHUNK, SCORED, COUNTED = 400_000, 4_000_000, 1_000_000
#: The type of numbers in the model.
NUMBER = np.int16
#: Classes whose weights take a step together, so many that they stay in a core's cache.
TOGETHER = 8
BLOCKS, SLOTS, ROWS = 16, 1 << 20, 1024
END = np.uint64(0x9E3779B97F4A7C15)
SEED = 11


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def token_lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The token hashes of each text, the end token last."""
    for _, _, raw, at in text_chunks(column):
        h, bounds = word_hashes(raw.lower(), at)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.append(h[a:b], END)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    pending = 0

    def flush():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["token", "n"])

    for batch in slices(batches, column=0):
        for tokens in token_lists(batch.column(0)):
            held.append(tokens)
            pending += len(tokens)
            if pending >= COUNTED:
                yield flush()
                held, pending = [], 0
    if held:
        yield flush()


class Vocabulary:
    """The most frequent tokens: their counts and their numbers in the model. Other tokens have number `tail`."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        end = np.flatnonzero(tokens == END)
        if not len(end):
            tokens, counts = np.append(tokens, END), np.append(counts, 0)
            end = np.array([len(tokens) - 1])
        rank = np.lexsort((tokens, -counts))
        rank = np.concatenate([rank[:MODEL_WORDS][rank[:MODEL_WORDS] != end[0]][: MODEL_WORDS - 1], end])
        number = np.full(len(tokens), -1)
        number[rank] = np.arange(len(rank))
        self.words, self.total, self.distinct = len(rank), total, distinct
        self.classes = -(-self.words // CLASS_WORDS)
        self.tail, self.start = self.words, self.words + 1
        self.counts = counts[rank].astype(np.float64)
        # Everything outside the model, and one place for the unknown.
        self.tail_mass = max(1.0, total + distinct + 1 - float((self.counts + 1).sum()))
        order = np.argsort(tokens)
        self.tokens, self.known_counts = tokens[order], counts[order]
        self.numbers = np.where(number[order] >= 0, number[order], self.tail)
        # By the low bits of a token, the last known token of these bits.
        self.slots = np.zeros(SLOTS, np.int32)
        self.slots[self.tokens & np.uint64(SLOTS - 1)] = np.arange(len(self.tokens))

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number in the model, and count (-1 where it isn't among the known)."""
        low = np.uint64(SLOTS - 1)
        at = self.slots[tokens & low]
        same = self.tokens[at] == tokens
        missed = np.flatnonzero(~same)
        missed = missed[(self.tokens[at[missed]] & low) == (tokens[missed] & low)]  # the place is taken by another one
        at[missed] = np.minimum(np.searchsorted(self.tokens, tokens[missed]), len(self.tokens) - 1)
        same[missed] = self.tokens[at[missed]] == tokens[missed]
        return np.where(same, self.numbers[at], self.tail), np.where(same, self.known_counts[at], -1)


class Space:
    """Arrays by name that are used again from call to call: fresh ones of this size have to be paged in each time, which took a
    quarter of the training's time. What was in an array of the name before is gone."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of each row's softmax at one place, the logits being lost; shifted by the rows' maxima only where exp would overflow
    without."""
    most = logits.max(initial=0)
    if not -80 < logits.min(initial=0) <= most < 80:
        logits -= logits.max(1, keepdims=True)
    out = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    out -= np.log(logits @ np.ones(logits.shape[1], np.float32))
    return out


class Network:
    """Weights of the recurrent network. Classes 0.. hold CLASS_WORDS numbers each, the last one is the tail.

    A table and its biases are one array, which a product with a row that ends with 1 reads at once: `inputs` (embed, and a column
    of ones), `gate` (wx, b), `top` (wc, bc) and `word` (wo, bo). States are worked out with a lane in each column, so that gates
    are whole stretches of memory; a step's state and inputs stand below each other and meet all gates in one product."""

    NAMES = ("embed", "wx", "wh", "b", "wc", "bc", "wo", "bo")
    TABLES = ("gate", "wh", "top", "word")

    def __init__(self, vocabulary: Vocabulary):
        v, rng = vocabulary, np.random.default_rng(SEED)
        k = v.classes * CLASS_WORDS
        self.words, self.classes, self.tail, self.start, self.space = v.words, v.classes, v.tail, v.start, Space()
        mass = np.zeros(k)
        mass[: v.words] = v.counts + 1
        by_class = mass.reshape(v.classes, CLASS_WORDS)
        self.inputs = np.ones((v.words + 2, EMBED + 1), np.float32)
        self.gate = np.zeros((EMBED + 1, 3 * HIDDEN), np.float32)
        self.top = np.zeros((HIDDEN + 1, v.classes + 1), np.float32)
        self.word = np.zeros((v.classes, HIDDEN + 1, CLASS_WORDS), np.float32)
        self.embed, self.wx, self.b = self.inputs[:, :EMBED], self.gate[:EMBED], self.gate[EMBED]
        self.wc, self.bc, self.wo, self.bo = self.top[:HIDDEN], self.top[HIDDEN], self.word[:, :HIDDEN], self.word[:, HIDDEN]
        self.embed[:] = rng.normal(0, 0.3, (v.words + 2, EMBED))
        self.wx[:] = rng.normal(0, 1 / np.sqrt(EMBED), (EMBED, 3 * HIDDEN))
        self.wh = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        self.bc[:] = np.log(np.append(by_class.sum(1), v.tail_mass))
        self.bc -= self.bc.max()
        self.bo[:] = np.where(by_class > 0, np.log(np.maximum(by_class, 1)) - np.log(np.maximum(by_class.max(1, keepdims=True), 1)), -60)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            old[...] = flat[at : at + old.size].reshape(old.shape)
            at += old.size
        return self

    def gates(self) -> np.ndarray:
        """What meets a state, its inputs and a one: the new state's recurrent part, both sigmoids with the sign that they need in exp,
        and the new state's other part."""
        n, every = HIDDEN, np.zeros((4 * HIDDEN, HIDDEN + EMBED + 1), np.float32)
        every[:n, :n] = self.wh[:, 2 * n :].T
        np.negative(self.wh[:, : 2 * n].T, out=every[n : 3 * n, :n])
        np.negative(self.gate[:, : 2 * n].T, out=every[n : 3 * n, n:])
        every[3 * n :, n:] = self.gate[:, 2 * n :].T
        return every

    def states(self, inputs: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The states of (steps, lanes) inputs from state h; the start symbol forgets what was before. They, and what is kept, hold until
        the next call."""
        (steps, lanes), size, space = inputs.shape, HIDDEN, self.space
        kept = steps if keep is not None else 1
        out, feed = space("out", steps, size, lanes), space("feed", steps + 1, size + EMBED + 1, lanes)
        opened, part, every = space("opened", kept, 4 * size, lanes), space("part", size, lanes), self.gates()
        feed[0, :size] = h.T
        feed[:steps, size:] = self.inputs.take(inputs, 0).transpose(0, 2, 1)
        fresh = inputs != self.start
        forgets = ~fresh.all(1)
        for t in range(steps):
            h = feed[t, :size]
            if forgets[t]:
                h *= fresh[t]
            g = opened[t if keep is not None else 0]
            np.matmul(every[size : 3 * size], feed[t], out=g[size : 3 * size])
            np.matmul(every[:size, :size], h, out=g[:size])
            np.matmul(every[3 * size :, size:], feed[t, size:], out=g[3 * size :])
            rz, n, after = g[size : 3 * size], g[3 * size :], out[t]
            np.exp(rz, out=rz)
            rz += 1
            np.reciprocal(rz, out=rz)
            np.multiply(rz[:size], g[:size], out=part)
            n += part
            np.tanh(n, out=n)
            np.subtract(h, n, out=after)
            after *= rz[size:]
            after += n
            feed[t + 1, :size] = after
        if keep is not None:
            keep += [feed[:steps], opened.reshape(steps, 4, size, lanes), fresh, forgets]
        return out.transpose(0, 2, 1)

    def rows(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The states at these places, each with a one at its end."""
        every = self.space("rows", *h.shape[:-1], HIDDEN + 1)
        every[..., :HIDDEN], every[..., HIDDEN] = h, 1
        return every.reshape(-1, HIDDEN + 1).take(at, 0, out=self.space("sorted", len(at), HIDDEN + 1), mode="clip")

    def class_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers == self.tail, self.classes, numbers // CLASS_WORDS)

    def sorted_by_class(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Places in the order of their numbers' classes, the classes in this order, and (class, from, to) of those with a softmax."""
        classes = self.class_of(numbers).astype(NUMBER)
        order = np.argsort(classes, kind="stable")
        classes = classes[order]
        bounds = np.searchsorted(classes, np.arange(self.classes + 1, dtype=NUMBER)).tolist()
        return order, classes, [(c, a, z) for c, (a, z) in enumerate(itertools.pairwise(bounds)) if a < z]

    def log_likelihoods(self, h: np.ndarray, targets: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each target number, of the tail class as a whole; at: the places of their states, if not all."""
        order, classes, spans = self.sorted_by_class(targets)
        rows = self.rows(h, order if at is None else at[order])
        within = targets[order] - classes.astype(np.int64) * CLASS_WORDS
        found = np.empty(len(order), np.float32)
        for a in range(0, len(order), ROWS):  # so many rows' logits stay in a core's cache
            part = rows[a : a + ROWS]
            found[a : a + ROWS] = _log_softmax_at(np.matmul(part, self.top, out=self.space("logits", len(part), self.classes + 1)), classes[a : a + ROWS])
        inside, k = spans[-1][2] if spans else 0, 0
        for a in range(0, inside, ROWS):
            z = min(inside, a + ROWS)
            logits = self.space("logits", z - a, CLASS_WORDS)
            while k < len(spans):
                c, start, end = spans[k]
                np.dot(rows[max(a, start) : min(end, z)], self.word[c], out=logits[max(a, start) - a : min(end, z) - a])
                if end > z:
                    break
                k += 1
            found[a:z] += _log_softmax_at(logits, within[a:z])
        out = np.empty_like(found)
        out[order] = found
        return out

    def ready(self) -> Network:
        """The network as scoring reads it: its tables hold their biases, so there is nothing to prepare."""
        return self


class Trainer:
    """Adagrad over windows; tables of words are updated where they are touched."""

    def __init__(self, network: Network):
        self.net, self.rate, self.seen = network, np.float32(RATE), 0
        past = {n: np.full_like(getattr(network, n), 1e-2) for n in Network.TABLES}
        parts = {"wx": past["gate"][:EMBED], "b": past["gate"][EMBED], "wc": past["top"][:HIDDEN], "bc": past["top"][HIDDEN]}
        parts |= {"wo": past["word"][:, :HIDDEN], "bo": past["word"][:, HIDDEN], "embed": np.full_like(network.embed, 1e-2)}
        self.past = past | parts

    def _step(self, name: str, gradient: np.ndarray, at: int | slice | np.ndarray = slice(None)) -> None:
        weights, past = getattr(self.net, name), self.past[name][at]
        move = gradient * gradient
        past += move
        if isinstance(at, np.ndarray):
            self.past[name][at] = past
        np.sqrt(past, out=move)
        np.divide(gradient, move, out=move)
        move *= self.rate
        weights[at] -= move

    @staticmethod
    def _slopes(logits: np.ndarray, want: np.ndarray, scale: np.float32) -> np.ndarray:
        """scale * (softmax - one at what was wanted), in the place of the logits."""
        if logits.max(initial=0) > 80:
            logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (scale / (logits @ np.ones(logits.shape[1], np.float32)))[:, None]
        logits[np.arange(len(want)), want] -= scale
        return logits

    def window(self, inputs: np.ndarray, targets: np.ndarray, used: np.ndarray, h: np.ndarray, places: int | None = None) -> np.ndarray:
        """Learn from one (steps, lanes) window of which some places are used; the state after it. places: what the loss is divided
        by; the number of places in use if none is given."""
        net, space, keep = self.net, self.net.space, []
        (steps, lanes), size = inputs.shape, HIDDEN
        self.rate, self.seen = np.float32(RATE / (1 + self.seen / DECAY) ** 0.5), self.seen + 1
        hs = net.states(inputs, h, keep)
        at = np.flatnonzero(used)
        order, classes, spans = net.sorted_by_class(targets.ravel()[at])
        at = at[order]
        rows, want = net.rows(hs, at), targets.ravel()[at]
        scale = np.float32(SCALE / (places or max(1, len(want))))
        p = self._slopes(np.matmul(rows, net.top, out=space("p", len(at), net.classes + 1)), classes, scale)
        dh, g_top = np.matmul(p, net.wc.T, out=space("dh", len(at), size)), (p.T @ rows).T
        if spans:
            inside = spans[-1][2]
            q, back, g_word = space("q", inside, CLASS_WORDS), space("back", inside, size), space("word", len(spans), size + 1, CLASS_WORDS)
            for c, a, z in spans:
                np.dot(rows[a:z], net.word[c], out=q[a:z])
            self._slopes(q, want[:inside] - classes[:inside].astype(np.int64) * CLASS_WORDS, scale)
            for k, (c, a, z) in enumerate(spans):
                np.dot(q[a:z], net.wo[c].T, out=back[a:z])
                np.dot(rows[a:z].T, q[a:z], out=g_word[k])
            dh[:inside] += back
            touched = np.array([c for c, _, _ in spans])
            for k in range(0, len(spans), TOGETHER):
                some = touched[k : k + TOGETHER]
                whole = some[-1] - some[0] < len(some)
                self._step("word", g_word[k : k + TOGETHER], slice(some[0], some[-1] + 1) if whole else some)
        self._step("top", g_top)
        by_row, all_dh = space("by_row", steps * lanes, size), space("all_dh", steps, size, lanes)
        if len(at) < len(by_row):
            by_row.fill(0)
        by_row[at] = dh
        all_dh[:] = by_row.reshape(steps, lanes, size).transpose(0, 2, 1)
        # Slopes of what the gates' products gave are the state's slope times what is known for all steps.
        feed, opened, fresh, forgets = keep
        g_n, r, z, n = opened.transpose(1, 0, 2, 3)
        by, shut = space("by", steps, 4, size, lanes), space("shut", steps, size, lanes)
        to_g, to_r, to_z, to_n = by.transpose(1, 0, 2, 3)
        np.subtract(1, z, out=shut)
        np.multiply(n, n, out=to_n)
        np.subtract(1, to_n, out=to_n)
        to_n *= shut
        np.multiply(to_n, r, out=to_g)
        np.subtract(1, r, out=to_r)
        to_r *= g_n
        to_r *= to_g
        np.subtract(feed[:, :size], n, out=to_z)
        to_z *= z
        to_z *= shut
        recurrent, carried = np.concatenate((net.wh[:, 2 * size :], net.wh[:, : 2 * size]), 1), by.reshape(steps, 4 * size, lanes)
        carry, back = np.zeros((size, lanes), np.float32), np.empty((size, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            d = all_dh[t]
            d += carry
            by[t] *= d
            np.matmul(recurrent, carried[t, : 3 * size], out=back)
            np.multiply(d, z[t], out=carry)
            carry += back
            if forgets[t]:
                carry *= fresh[t]
        slopes, fed = space("slopes", 4 * size, steps, lanes), space("fed", feed.shape[1], steps, lanes)
        slopes[:], fed[:] = carried.transpose(1, 0, 2), feed.transpose(1, 0, 2)
        slopes, fed = slopes.reshape(4 * size, -1), fed.reshape(feed.shape[1], -1)
        g_wh, g_gate = slopes[: 3 * size] @ fed[:size].T, slopes[size:] @ fed[size:].T
        flat_in = inputs.ravel()
        order = np.argsort(flat_in.astype(NUMBER), kind="stable")
        sorted_in = flat_in[order]
        starts = np.flatnonzero(np.append(True, sorted_in[1:] != sorted_in[:-1]))
        to_embed = np.matmul(slopes[size:].T, net.wx.T, out=space("to_embed", steps * lanes, EMBED))
        summed = np.add.reduceat(to_embed.take(order, 0), starts)
        g_wh = np.concatenate((g_wh[size:], g_wh[:size])).T
        for name, g, rows in (("wh", g_wh, slice(None)), ("gate", g_gate.T, slice(None)), ("embed", summed, sorted_in[starts])):
            self._step(name, np.clip(g, -CLIP, CLIP), rows)
        return hs[-1].copy()


def lanes_of(lengths: list[int], lanes: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, the longest lane first."""
    heap = [(0, i) for i in range(min(lanes, len(lengths)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        load, lane = heapq.heappop(heap)
        dealt[lane].append(d)
        heapq.heappush(heap, (load + lengths[d], lane))
    return sorted(dealt, key=lambda ds: -sum(lengths[d] for d in ds))


def windows(docs: list[np.ndarray], start: int, lanes: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, targets, document of each place or -1, lanes still in use) of each window over documents given as numbers;
    a lane goes on where it stopped, so the number of lanes only falls."""
    dealt = lanes_of([len(d) for d in docs], lanes)
    if not dealt:
        return
    lengths = np.array([sum(len(docs[d]) for d in ds) for ds in dealt])
    ends, every = np.cumsum(lengths), [d for ds in dealt for d in ds]
    said = np.concatenate([docs[d] for d in every])
    sizes = np.array([len(docs[d]) for d in every])
    heard = np.append(said[:1], said[:-1])
    heard[(np.cumsum(sizes) - sizes)[sizes > 0]] = start
    owners, firsts = np.repeat(np.array(every, np.int32), sizes), ends - lengths
    for at in range(0, int(lengths[0]), steps):
        live = int((lengths > at).sum())
        place = np.arange(at, min(at + steps, int(lengths[0])))[:, None]
        inputs, targets, owner = (c.take(place + firsts[:live], mode="clip") for c in (heard, said, owners))
        over = place >= lengths[:live]
        if at + len(place) > lengths[live - 1]:
            inputs[over], targets[over], owner[over] = start, 0, -1
        yield inputs, targets, owner, live


def _train(shared):
    """The task that trains on shards, whose documents come one after the other: blocks of a shard's weights, with the tokens that
    it learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        shard, trainer, held, pending, learned = None, None, [], 0, 0

        def learn() -> None:
            h = np.zeros((LANES, HIDDEN), np.float32)
            for inputs, targets, owner, live in windows(held, trainer.net.start, LANES, WINDOW):
                # Every token weighs the same: a window in which one long document is left mustn't take a whole window's step.
                h = trainer.window(inputs, targets, owner >= 0, h[:live], LANES * WINDOW)

        def ended() -> pa.RecordBatch:
            parts = np.array_split(trainer.net.flat(), BLOCKS)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(list(range(BLOCKS))),
                    pa.array([shard] * BLOCKS, pa.int64()),
                    pa.array([learned] * BLOCKS, pa.int64()),
                    pa.array([p.astype(np.float32) for p in parts], pa.list_(pa.float32()))
                ],
                names=["block", "part", "tokens", "weights"]
            )

        for batch in slices(batches, column=1):
            for of, tokens in zip(batch.column(0).to_pylist(), token_lists(batch.column(1)), strict=True):
                if of != shard or pending >= CHUNK:
                    if held:
                        learn()
                    held, pending, learned = [], 0, learned + pending
                    if of != shard:
                        if shard is not None:
                            yield ended()
                        shard, trainer, learned = of, Trainer(Network(vocabulary).load(weights)), 0
                held.append(vocabulary.look_up(tokens)[0].astype(NUMBER))
                pending += len(tokens)
        if held:
            learn()
            learned += pending
            yield ended()

    return run


def _average(group: pa.Table) -> pa.Table:
    tokens = group["tokens"].to_numpy().astype(np.float64)
    order = np.argsort(group["part"].to_numpy(), kind="stable")
    rows = group["weights"].combine_chunks().flatten().to_numpy().reshape(len(tokens), -1)
    mean = sum(tokens[i] * rows[i].astype(np.float64) for i in order) / tokens.sum()
    return pa.table(
        {
            "block": group["block"][:1],
            "part": group["part"][:1],
            "tokens": pa.array([int(tokens.sum())]),
            "weights": pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))
        }
    )


def trained(training: DataFrame, vocabulary: Vocabulary, scratch: Scratch) -> np.ndarray:
    """The weights after all rounds. training: doc_id and text of the training documents."""
    spark = training.sparkSession
    weights = Network(vocabulary).flat()
    shards = int(min(MOST_SHARDS, max(1, vocabulary.total // (ROUNDS * SHARD_TOKENS))))
    place = F.xxhash64(F.lit(SEED), "doc_id", "text")
    dealt = training.select(place.alias("place"), "text").withColumn("round", F.pmod("place", F.lit(ROUNDS))).withColumn(
        "shard", F.pmod(F.shiftright("place", 8), F.lit(shards))
    )
    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((vocabulary, weights))
        share = dealt.where(F.col("round") == round_).repartitionById(
            shards, F.col("shard").cast("int")
        ).sortWithinPartitions("shard", "place", "text").select("shard", "text")
        schema = "block long, part long, tokens long, weights array<float>"
        parts = scratch.table(share.mapInArrow(_train(shared), schema), "weights")
        most = parts.agg(F.max("part")).first()[0]
        if most is None:
            return weights
        while True:  # at most 64 models meet in a group, in as many levels as that takes
            most //= 64
            parts = parts.withColumn("part", F.floor(F.col("part") / 64)).groupBy("block", "part").applyInArrow(_average, schema)
            if not most:
                break
            parts = scratch.table(parts, "weights")
        weights = np.concatenate([np.array(r["weights"], np.float32) for r in parts.orderBy("block").collect()])
    return weights


def _score(shared):
    """The task that scores documents: a row for each (kind 0) and a row for each of its tokens outside the known (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        net = Network(vocabulary).load(weights).ready()
        held: list = []
        looked_up: list = []  # for each document its numbers and what is known without the network
        pending = waiting = 0

        def rows(kind, keys, **columns):
            n = len(keys)
            fill = {
                "doc_id": pa.nulls(n, pa.int64()), "held_out": pa.nulls(n, pa.bool_()), "token": pa.nulls(n, pa.int64()),
                "n": np.zeros(n, np.int64), "known": np.zeros(n, np.int64), "tail": np.zeros(n, np.int64), "logs": np.zeros(n),
                "model": np.zeros(n)
            } | columns
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, kind, np.int32)),
                    pa.array(keys, pa.int64()),
                    *(c if isinstance(c, pa.Array) else pa.array(c) for c in fill.values())
                ],
                names=["kind", "row", *fill]
            )

        def flush():
            sizes = np.array([len(d[3]) for d in held])
            tokens, which = np.concatenate([d[3] for d in held]), np.repeat(np.arange(len(held)), sizes)
            number, count = vocabulary.look_up(tokens)
            per_doc = lambda values: np.bincount(which, values, len(held))
            outside, log = number == net.tail, np.log10(np.maximum(count, 0) + 1.0)
            columns = (
                np.array([d[0] for d in held], np.int64), [d[1] for d in held], [d[2] for d in held], sizes, per_doc(count > 0).astype(np.int64),
                per_doc(outside).astype(np.int64), per_doc(log), per_doc(log * outside)
            )
            looked_up.extend(zip(np.split(number.astype(NUMBER), np.cumsum(sizes)[:-1]), *columns, strict=True))
            rare = np.flatnonzero(count < 0)
            if len(rare):
                order = np.lexsort((tokens[rare], which[rare]))
                rare = rare[order]
                fresh = np.flatnonzero(np.append(True, (which[rare[1:]] != which[rare[:-1]]) | (tokens[rare[1:]] != tokens[rare[:-1]])))
                keys = np.array([d[0] for d in held], np.int64)[which[rare[fresh]]]
                yield rows(1, keys, token=tokens[rare[fresh]].view(np.int64), n=np.diff(np.append(fresh, len(rare))).astype(np.int64))

        def scored():
            docs, keys, ids, outs, sizes, known, tail, logs, tail_logs = zip(*looked_up, strict=True)
            total = np.zeros(len(docs))
            h = np.zeros((SCORE_LANES, HIDDEN), np.float32)
            for inputs, targets, owner, live in windows(docs, net.start, SCORE_LANES, SCORE_WINDOW):
                hs = net.states(inputs, h[:live])
                h, used = hs[-1], owner >= 0
                found = net.log_likelihoods(hs, targets[used], np.flatnonzero(used))
                total += np.bincount(owner[used], found, len(docs))
            yield rows(
                0,
                keys,
                doc_id=pa.array(ids, pa.int64()),
                held_out=pa.array(outs, pa.bool_()),
                n=np.array(sizes, np.int64),
                known=np.array(known, np.int64),
                tail=np.array(tail, np.int64),
                logs=np.array(logs),
                model=total / np.log(10) + np.array(tail_logs)
            )

        for batch in slices(batches, column=3):
            for row, doc_id, out, tokens in zip(
                batch.column(0).to_pylist(),
                batch.column(1).to_pylist(),
                batch.column(2).to_pylist(),
                token_lists(batch.column(3)),
                strict=True
            ):
                held.append((row, doc_id, out, tokens))
                pending += len(tokens)
                if pending >= CHUNK:
                    yield from flush()
                    waiting, held, pending = waiting + pending, [], 0
                    if waiting >= SCORED:
                        yield from scored()
                        looked_up, waiting = [], 0
        if held:
            yield from flush()
        if looked_up:
            yield from scored()

    return run


def language_scores(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text")
    )
    training = docs.where(~F.col("held_out")).select("doc_id", "text")
    counts = scratch.table(training.select("text").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    whole = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    total, distinct = whole["total"] or 0, whole["distinct"]
    top = counts.orderBy(F.desc("n"), "token").limit(KNOWN).toArrow()
    vocabulary = Vocabulary(top["token"].to_numpy().view(np.uint64), top["n"].to_numpy().copy(), total, distinct)
    weights = trained(training, vocabulary, scratch)

    shared = spark.sparkContext.broadcast((vocabulary, weights))
    scored = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    scored = scored.mapInArrow(
        _score(shared),
        "kind int, row long, doc_id long, held_out boolean, token long, n long, known long, tail long, logs double, model double"
    )
    scored = scratch.table(scored, "scored")
    rare = scored.where("kind = 1").select("row", "token", F.col("n").alias("times")).join(counts, "token")
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_logs"), F.sum("times").alias("rare_known"))
    out = scored.where("kind = 0").join(rare, "row", "left").withColumn("rare_logs", F.coalesce("rare_logs", F.lit(0.0)))
    return out.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("model") + F.col("rare_logs") - F.col("tail") * float(np.log10(vocabulary.tail_mass))).alias("score"),
    )

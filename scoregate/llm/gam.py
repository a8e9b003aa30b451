"""Quality classifier: a generalised additive model with pairwise interactions.

Method: every feature of a text is cut into bins; cyclic boosting visits the features in turn and fits, to the gradient
of the log loss, a shallow tree of at most LEAVES leaves over that feature's bins, which is added to the feature's lookup
table. The pairs with the largest gain left then get two-dimensional tables from trees with one cut on each axis. A score
is the logistic of an intercept plus one table entry for each feature and pair: vectorised bin additions.

Features come from whole texts, in one pass over the bytes. The model is fitted on at most ``fit_rows`` labelled rows,
those with the smallest hashes of their doc_id (a documented bound); scoring covers every row.

Defined cases: a null or empty text has all features zero and is scored like any other; a text of white space alone has
a length but no words; without labels of both classes every score is the smoothed share of label 1 (0.5 without labels);
null labels and null ids teach nothing, and of several labels of one doc_id the smallest counts; repeated rows stay;
further columns stay in score_documents and are ignored elsewhere; empty tables give empty results."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from scoregate.llm.common import Scratch, free_name, ship, slices, text_chunks, window_hashes, word_hashes

FEATURES = (
    "bytes", "words", "word_bytes", "upper", "symbols", "marks", "stops", "digits", "non_ascii", "lines", "repeated_lines",
    "distinct", "repeated_runs", "short_words", "top_word", "space"
)
FIT_ROWS, BINS, LEAVES = 20_000, 48, 3
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, MIN_HESSIAN, PENALTY = 120, 60, 6, 0.15, 2.0, 1.0

_CLASS = np.zeros(256, np.uint8)
for _kind, _bytes in (
    (1, range(65, 91)), (2, b"#*$%&|<>"), (3, b"!?"), (4, b".,;:"), (5, range(48, 58)), (6, range(128, 256)), (7, b"\n"),
    (8, b" \t\r\x0b\x0c")
):
    _CLASS[list(_bytes)] = _kind
_RUN = 8


def text_features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text of a string column."""
    out = np.zeros((len(column), len(FEATURES)))
    for row, end, raw, at in text_chunks(column):
        n = end - row
        kinds = _CLASS[np.frombuffer(raw, np.uint8)]
        sizes = np.diff(at)
        owner = np.repeat(np.arange(n), sizes)
        by_kind = np.bincount(owner * 9 + kinds, minlength=9 * n).reshape(n, 9).astype(float)
        h, bounds = word_hashes(raw, at)
        words = np.diff(bounds)
        lengths = (sizes - by_kind[:, 7] - by_kind[:, 8]) / np.maximum(words, 1)
        per_byte, per_word = 1 / np.maximum(sizes, 1), 1 / np.maximum(words, 1)
        f = out[row:end]
        f[:, 0], f[:, 1], f[:, 2] = np.log1p(sizes), np.log1p(words), lengths
        f[:, 3] = by_kind[:, 1] * per_byte
        for j, kind in ((4, 2), (5, 3), (6, 4), (9, 7)):
            f[:, j] = by_kind[:, kind] * per_word
        f[:, 7], f[:, 8], f[:, 15] = by_kind[:, 5] * per_byte, by_kind[:, 6] * per_byte, (by_kind[:, 7] + by_kind[:, 8]) * per_byte
        runs = window_hashes(h, _RUN) if len(h) >= _RUN else h[:0]
        for i in range(n):
            a, b = bounds[i], bounds[i + 1]
            if a == b:
                continue
            own = np.sort(h[a:b])
            change = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            f[i, 11] = (len(change) - 1) / (b - a)
            f[i, 14] = np.diff(change).max() / (b - a)
            if b - a >= _RUN:
                own = np.sort(runs[a : b - _RUN + 1])
                f[i, 12] = 1 - (1 + np.count_nonzero(own[1:] != own[:-1])) / len(own)
            lines = [x for x in raw[at[i] : at[i + 1]].split(b"\n") if x]
            if len(lines) > 1:
                f[i, 10] = 1 - len(set(lines)) / len(lines)
        starts = np.flatnonzero(kinds < 7)
        if len(starts):  # words of up to three bytes
            breaks = np.flatnonzero(np.concatenate(([True], np.diff(starts) > 1)) | np.isin(starts, at))
            width = np.diff(np.append(breaks, len(starts)))
            f[:, 13] = np.bincount(owner[starts[breaks]], weights=width <= 3, minlength=n) * per_word
    return out


@dataclass
class Model:
    """edges: the upper bounds of each feature's bins; tables: its lookup table; pairs: (feature, feature, table)."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for i, j, table in self.pairs:
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g, h):
    return g * g / (h + PENALTY)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The Newton steps of a tree with at most LEAVES leaves over ordered bins with gradients g and hessians h."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    leaves = [(0, len(g))]

    def best(a: int, b: int):
        cut = np.arange(a + 1, b)
        lg, lh, all_g, all_h = cg[cut] - cg[a], ch[cut] - ch[a], cg[b] - cg[a], ch[b] - ch[a]
        gain = np.where((lh >= MIN_HESSIAN) & (all_h - lh >= MIN_HESSIAN), _gain(lg, lh) + _gain(all_g - lg, all_h - lh) - _gain(all_g, all_h), 0)
        k = int(np.argmax(gain)) if len(gain) else 0
        return (gain[k], a, cut[k], b) if len(gain) else (0.0, a, a, b)

    while len(leaves) < LEAVES:
        gain, a, cut, b = max((best(a, b) for a, b in leaves), key=lambda x: x[0])
        if gain <= 1e-9:
            break
        leaves.remove((a, b))
        leaves += [(a, cut), (cut, b)]
    step = np.zeros(len(g))
    for a, b in leaves:
        step[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + PENALTY)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree with one cut on each axis of a grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    all_g, all_h = cg[-1, -1], ch[-1, -1]

    def parts(c, total):
        a = c[:-1, :-1]
        top, left = c[:-1, -1:], c[-1:, :-1]
        return a, top - a, left - a, total - top - left + a

    pg, ph = parts(cg, all_g), parts(ch, all_h)
    gain = sum(_gain(x, y) for x, y in zip(pg, ph, strict=True)) - _gain(all_g, all_h)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    step = np.zeros_like(g)
    for k, (rows, cols) in enumerate(
        (
            (slice(0, i + 1), slice(0, j + 1)),
            (slice(0, i + 1), slice(j + 1, None)),
            (slice(i + 1, None), slice(0, j + 1)),
            (slice(i + 1, None), slice(j + 1, None))
        )
    ):
        step[rows, cols] = -pg[k][i, j] / (ph[k][i, j] + PENALTY)
    return float(gain[i, j]), step


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of labelled feature rows."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    width = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(w) for w in width]
    b = model.bins(x)
    f = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, w in enumerate(width):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, j], g, w), np.bincount(b[:, j], h, w))
            model.tables[j] += step
            f += step[b[:, j]]
    g, h = slopes()

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(b[:, i] * width[j] + b[:, j], values, width[i] * width[j]).reshape(width[i], width[j])

    ranked = sorted((-_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(width)) for j in range(i) if width[i] > 1 and width[j] > 1)
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            f += step[b[:, i], b[:, j]]
    return model


def features(documents: DataFrame) -> DataFrame:
    """doc_id and the array ``features`` of every row."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = text_features(batch.column(1))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "features"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, features array<double>")


def held_out(doc_id):
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(described: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, label: str = "quality") -> Model:
    """A model from the rows of ``features`` that have a label and aren't held out, of these at most fit_rows."""
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")
    ).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = described.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(fit_rows).select("features", "label").toArrow()
    x = np.array(rows["features"].to_pylist(), float).reshape(rows.num_rows, len(FEATURES))
    return fit_arrays(x, rows["label"].to_numpy().astype(float))


def score_features(described: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``features``."""
    ship(described.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return described.mapInArrow(run, "doc_id long, score double")


def score_documents(documents: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """The documents with their score as a further column (in the place of one of its name), without any shuffle."""
    ship(documents.sparkSession)
    schema = T.StructType([f for f in documents.schema.fields if f.name != score] + [T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = [i for i, n in enumerate(batch.schema.names) if n != score]
            found = model.score(text_features(batch.column(batch.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(found)], names=[*(batch.schema.names[i] for i in kept), score])

    return documents.mapInArrow(run, schema)


def quality_scores(documents: DataFrame, labels: DataFrame, cut: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `cut` on) of every document."""
    described = Scratch(documents.sparkSession).table(features(documents), "features")
    model = fit(described, labels, fit_rows)
    return score_features(described, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= cut, 1).otherwise(0).cast("int").alias("predicted")
    )


def accepted(documents: DataFrame, labels: DataFrame, cut: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that the model scores at least `cut`, with their own columns."""
    described = Scratch(documents.sparkSession).table(features(documents), "features")
    model = fit(described, labels, fit_rows)
    score = free_name(documents, "__sg_score")
    return score_documents(documents, model, score).where(F.col(score) >= cut).drop(score)

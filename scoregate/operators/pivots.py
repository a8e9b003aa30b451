"""Exact nearest neighbours in a large bank, with most of it never compared.

The bank's vectors are put to the nearest of a few pivots and told their distance from it. A query knows its distance from each
pivot, so by the triangle inequality it needs no vector whose own distance from the pivot differs from that by more than the best
distance found so far: whole clusters fall out by their largest radius, and of the others a run of vectors sorted by radius is
left. Pieces of the bank of at most PIECE_BYTES (a large cluster in several) are broadcast one after another; queries stay
where they are, carry their best distance from piece to piece, and are never shuffled or joined. Pivots come from a sample and decide
the work alone, not the result.

Defined cases: a query that is null, or of another length than the bank's vectors, and any query of an empty bank has a null
distance; null vectors of the bank are left out, copies count once; a zero vector has cosine 0 with all; the distance is 1 - cosine
within 0 and 2; repeated queries stay; helper columns begin with ``__sg_``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scoregate.sources.stages import staged

#: Vectors drawn for pivots, pivots at most, bytes of a piece, queries worked on at a time, and what rounding may be off by.
SAMPLE, PIVOTS, PIECE_BYTES, QUERIES, SLACK = 4096, 512, 32 << 20, 1024, 1e-9


@dataclass
class Piece:
    """Clusters of unit vectors, each sorted by distance from its pivot: rows begin[i] to begin[i + 1] belong to pivots[i]."""

    vectors: np.ndarray
    radius: np.ndarray
    pivots: np.ndarray
    begin: np.ndarray


def unit_rows(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the given length (else that of the first one) over their length, and their row numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    if width is None:
        width = int(lengths.max(initial=0))
    there = np.flatnonzero((lengths == width) & (width > 0))
    flat = column.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(there), width)
    whole = np.isfinite(flat).all(1)
    flat, there = flat[whole], there[whole]
    return flat / np.maximum(np.sqrt((flat * flat).sum(1)), 1e-12)[:, None], there


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a from those of b, which obey the triangle inequality whatever their lengths."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def chosen(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots far from each other: each one the vector farthest from those before."""
    if not len(sample):
        return sample
    out, away = [0], chord(sample, sample[:1])[:, 0]
    while len(out) < most and away.max() > 1e-6:
        out.append(int(away.argmax()))
        away = np.minimum(away, chord(sample, sample[out[-1:]])[:, 0])
    return sample[out]


def search(queries: np.ndarray, best: np.ndarray, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """The least chord of each query to the piece's vectors or what it had, and how many vectors were compared."""
    best, compared = best.copy(), np.zeros(len(queries), np.int64)
    away = chord(queries, piece.pivots)
    reach = np.array([piece.radius[e - 1] for e in piece.begin[1:]])

    def look(c: int, asked: np.ndarray) -> None:
        begin, end = piece.begin[c], piece.begin[c + 1]
        radius = piece.radius[begin:end]
        low = begin + int(np.searchsorted(radius, (away[asked, c] - best[asked]).min() - SLACK))
        high = begin + int(np.searchsorted(radius, (away[asked, c] + best[asked]).max() + SLACK, "right"))
        if low < high:
            found = chord(queries[asked], piece.vectors[low:high]).min(1)
            best[asked] = np.minimum(best[asked], found)
            compared[asked] += high - low

    first = away.argmin(1)
    order = np.argsort(first, kind="stable")
    for c, asked in zip(*(lambda k, at: (k, np.split(order, at[1:])))(*np.unique(first[order], return_index=True)), strict=True):
        look(int(c), asked)
    for c in range(len(piece.pivots)):
        asked = np.flatnonzero((away[:, c] - reach[c] < best + SLACK) & (first != c))
        if len(asked):  # those alike in their distance from the pivot look at one run
            for part in np.array_split(asked[np.argsort(away[asked, c])], -(-len(asked) // 64)):
                look(c, part)
    return best, compared


def _pieces(bank: DataFrame) -> tuple[int, Iterator[Piece]]:
    """The length of the bank's vectors and its pieces, one after another."""
    spark = bank.sparkSession
    rows = bank.count()
    longest = bank.agg(F.max(F.size("patch"))).first()[0] or 0
    drawn = bank.where(F.pmod(F.xxhash64("patch"), F.lit(1 << 30)) / float(1 << 30) < SAMPLE / max(rows, 1)).limit(4 * SAMPLE).toArrow()
    sample = unit_rows(drawn["patch"], longest)[0]
    if not len(sample):
        sample = unit_rows(bank.limit(SAMPLE).toArrow()["patch"], longest)[0]
    pivots = chosen(sample, int(min(PIVOTS, max(1, np.sqrt(rows)))))
    if not len(pivots):
        return longest, iter(())
    shared = spark.sparkContext.broadcast(pivots)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = unit_rows(batch.column(0), longest)
            x = x[x.any(1)]
            if len(x):
                away = chord(x, shared.value)
                near = away.argmin(1)
                vectors = pa.ListArray.from_arrays(np.arange(0, x.size + 1, longest, np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(x)), near]), vectors],
                    names=["pivot", "radius", "vector"]
                )

    placed = staged(bank.select("patch").mapInArrow(put, "pivot int, radius double, vector array<double>"))
    sizes = {r["pivot"]: r["count"] for r in placed.groupBy("pivot").count().collect()}  # a row for each pivot
    most, groups, held = max(1, PIECE_BYTES // (8 * longest)), [], 0
    for pivot, n in sorted(sizes.items()):
        parts = -(-n // most)
        for k in range(parts):
            if not groups or held + n / parts > most:
                groups.append([])
                held = 0
            groups[-1].append((pivot, k, parts))
            held += n / parts

    def each() -> Iterator[Piece]:
        for group in groups:
            wanted = F.lit(False)
            for pivot, k, parts in group:
                wanted = wanted | (
                    (F.col("pivot") == pivot) & (F.pmod(F.xxhash64("vector"), F.lit(parts)) == k)
                ) if parts > 1 else wanted | (F.col("pivot") == pivot)
            table = placed.where(wanted).toArrow().sort_by([("pivot", "ascending"), ("radius", "ascending")])
            if table.num_rows:
                own = table["pivot"].to_numpy()
                found, begin = np.unique(own, return_index=True)
                yield Piece(
                    table["vector"].combine_chunks().flatten().to_numpy().reshape(-1, longest),
                    table["radius"].to_numpy(),
                    pivots[found],
                    np.append(begin, len(own))
                )

    return longest, each()


def nearest_in_bank(queries: DataFrame, item: str, reference: DataFrame) -> DataFrame:
    """The cosine distance of each query (item, position, patch) to the nearest patch of the reference, and compared: with how many of
    the bank's different patches it was compared."""
    bank = staged(reference.select(F.col("patch").cast("array<double>").alias("patch")).where(F.col("patch").isNotNull()).distinct())
    width, pieces = _pieces(bank)
    kind = queries.schema[item].dataType.simpleString()
    schema = f"{item} {kind}, position int, patch array<double>, __sg_best double, compared long"
    asked = queries.select(
        item,
        F.col("position").cast("int").alias("position"),
        F.col("patch").cast("array<double>").alias("patch"),
        F.lit(float("inf")).alias("__sg_best"),
        F.lit(0).cast("long").alias("compared")
    )
    for piece in pieces:
        shared = queries.sparkSession.sparkContext.broadcast(piece)
        asked = staged(asked.mapInArrow(_step(shared, width), schema))
        shared.destroy()
    # Zero vectors stand at no angle to any: their distance is 1, and theirs to all is.
    nothing = lambda c: (F.size(c) == width) & F.forall(c, lambda x: x == 0)
    some, zero = (not bank.where(F.size("patch") == width).where(c).isEmpty() for c in (F.lit(True), nothing("patch")))
    asked = asked.withColumn(
        "__sg_best",
        F.when(F.lit(some) & nothing("patch"), F.sqrt(F.lit(2.0))).when(
            F.lit(zero) & (F.size("patch") == width), F.least("__sg_best", F.sqrt(F.lit(2.0)))
        ).otherwise(F.col("__sg_best"))
    )
    distance = F.when(F.col("__sg_best") < float("inf"), F.least(F.greatest(F.col("__sg_best") * F.col("__sg_best") / 2, F.lit(0.0)), F.lit(2.0)))
    return asked.select(item, "position", distance.alias("distance"), "compared")


def _step(shared, width: int):
    """Each query's best distance after one more piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, compared = batch.column(3).to_numpy().copy(), batch.column(4).to_numpy().copy()
            x, there = unit_rows(batch.column(2), width)
            for a in range(0, len(x), QUERIES):
                at = there[a : a + QUERIES]
                best[at], more = search(x[a : a + QUERIES], best[at], shared.value)
                compared[at] += more
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(best), pa.array(compared)], names=batch.schema.names)

    return run

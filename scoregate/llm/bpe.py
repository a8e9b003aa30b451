"""BPE encoding and decoding with a byte-level vocabulary.

Method: a segment tree over the ranks of adjacent pairs. A leaf holds rank * width + position of the pair that starts at
its symbol, or infinity; every node holds the smaller of its children, so the root is the leftmost pair of the lowest
rank. A merge is a descent-free read of the root and at most three point updates of O(log n); it ends when the root is
infinite. The trees of many short pieces of like length stand in one array and go through their merges side by side, each with
its own root and updates; long pieces, and the few of a rare length, are merged one by one. Ids of short pieces are kept in a
memo of bounded size.

Defined cases: a null text encodes to no ids and decodes to the empty text; strings of added tokens inside a text become
their ids; ids unknown to the vocabulary are passed over when decoding, a null list decodes to the empty text, and bytes
that aren't UTF-8 become U+FFFD; repeated rows, null ids and further columns stay as they are (the new column replaces
one of its name); an empty table gives an empty result."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from scoregate.llm.bpe_model import LONGEST, Model, load, memo_for
from scoregate.llm.common import kept_by, ship, slices

#: Texts cut and encoded together, and decoded together in whole arrays.
ENCODED_AT_ONCE, DECODED_AT_ONCE = 256, 256
#: Pieces whose trees stand in one array: at least, at most.
FEWEST, MOST = 24, 4096
_NEVER = np.int64(1 << 62)


def piece_encoder(model: Model):
    """A function from a piece (or an added token's id) to its ids, as the bytes of 32-bit integers."""
    symbols = model.symbols
    m, pairs = model.pairs()
    pair = pairs.get
    never = 1 << 62

    def encode(piece) -> bytes:
        if type(piece) is int:
            return np.int32(piece).tobytes()
        held = [symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(held)
        if n < 2:
            return np.array(held, np.int32).tobytes()
        width = 1 << (n - 2).bit_length()
        tree = [never] * (2 * width)
        for i in range(n - 1):
            if found := pair(held[i] * m + held[i + 1]):
                tree[width + i] = found[0] * width + i
        for at in range(width - 1, 0, -1):
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) != never:
            i = root % width
            j = after[i]
            merged = held[i] = pair(held[i] * m + held[j])[1]
            held[j] = -1
            k = after[i] = after[j]
            # The three leaves that change: the pairs that start before, at and after the merge.
            y = width + i
            if k < n:
                before[k] = i
                found = pair(merged * m + held[k])
                tree[y] = found[0] * width + i if found else never
            else:
                tree[y] = never
            z = y
            if j < n - 1:
                z = width + j
                tree[z] = never
            h = before[i]
            x = y
            if h >= 0:
                x = width + h
                found = pair(held[h] * m + merged)
                tree[x] = found[0] * width + h if found else never
            while y > 1:
                x >>= 1
                y >>= 1
                z >>= 1
                a, b = tree[2 * y], tree[2 * y + 1]
                tree[y] = a if a < b else b
                if x != y:
                    a, b = tree[2 * x], tree[2 * x + 1]
                    tree[x] = a if a < b else b
                if z != y:
                    a, b = tree[2 * z], tree[2 * z + 1]
                    tree[z] = a if a < b else b
        return array("i", [s for s in held if s >= 0]).tobytes()

    return encode


class PairTable:
    """Ranks of pairs of symbols, looked up for whole arrays: a slot by the pair's hash, a search where pairs share a slot."""

    SLOTS = 20

    def __init__(self, model: Model):
        self.m, pairs = model.pairs()
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.zeros(int(self.ranks.max(initial=0)) + 1, np.int64)
        self.merged[self.ranks] = [pairs[k][1] for k in self.keys.tolist()]
        slot = self._slot(self.keys)
        self.at = np.zeros(1 << self.SLOTS, np.int32)
        self.at[slot] = np.arange(len(self.keys))
        self.shared = np.bincount(slot, minlength=1 << self.SLOTS) > 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def leaves(self, a: np.ndarray, b: np.ndarray, width: int, place: np.ndarray) -> np.ndarray:
        """rank * width + place of each pair, _NEVER where there is none; a symbol below 0 pairs with nothing."""
        if not len(self.keys):
            return np.full(len(a), _NEVER)
        keys = a * self.m + b
        slot = self._slot(keys)
        at = self.at[slot]
        found = self.keys[at] == keys
        again = np.flatnonzero(~found & self.shared[slot])
        if len(again):
            at[again] = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            found[again] = self.keys[at[again]] == keys[again]
        return np.where(found & (a >= 0) & (b >= 0), self.ranks[at] * width + place, _NEVER)


def forest_encoder(model: Model):
    """A function from pieces (or added tokens' ids) to their ids, each as the bytes of 32-bit integers."""
    one, table = piece_encoder(model), PairTable(model)
    symbols = np.array(model.symbols, np.int64)

    def grown(raw: list[bytes], width: int) -> list[bytes]:
        """Pieces of 2 to width + 1 bytes: a tree of `width` leaves for each, all in one array."""
        count = len(raw)
        n = np.fromiter(map(len, raw), np.int64, count)
        span = width + 2  # a piece's symbols and the place after its last one
        held = np.full((count, span), -1, np.int64)
        held[np.arange(span)[None] < n[:, None]] = symbols[np.frombuffer(b"".join(raw), np.uint8)]
        tree = np.full((count, 2 * width), _NEVER)
        tree[:, width:] = table.leaves(held[:, :width].ravel(), held[:, 1 : width + 1].ravel(), width, np.tile(np.arange(width), count)).reshape(count, width)
        low = width
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        after, before = (np.tile(np.arange(d, span + d), (count, 1)).ravel() for d in (1, -1))
        flat, leaf = held.ravel(), tree.ravel()
        rows = np.arange(count)
        while True:
            root = leaf[rows * 2 * width + 1]
            live = root != _NEVER
            rows, root = rows[live], root[live]
            if not len(rows):
                break
            start, top = rows * span, rows * 2 * width
            i, merged = root % width, table.merged[root // width]
            j = after[start + i]
            k = np.minimum(after[start + j], span - 1)
            h = before[start + i]
            flat[start + i], flat[start + j] = merged, -1
            after[start + i], before[start + k] = k, i
            # The three leaves that change: the pairs that start at, before and after the merge, that at the merge last.
            j, left = np.where(j < width, j, i), np.maximum(h, 0)
            leaf[top + width + j] = _NEVER
            leaf[top + width + np.where(h < 0, i, h)] = table.leaves(np.where(h < 0, -1, flat[start + left]), merged, width, left)
            leaf[top + width + i] = table.leaves(merged, flat[start + k], width, i)
            at, tops = np.concatenate((i, np.where(h < 0, i, h), j)) + width, np.concatenate((top, top, top))
            for _ in range(width.bit_length() - 1):
                at >>= 1
                low = tops + 2 * at
                leaf[tops + at] = np.minimum(leaf[low], leaf[low + 1])
        kept = held >= 0
        ends = np.concatenate(([0], np.cumsum(kept.sum(1)) * 4)).tolist()
        data = held[kept].astype(np.int32).tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(pieces: list) -> list[bytes]:
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        raw = [b"" if type(p) is int else p.encode("utf-8", "surrogatepass") for p in pieces]
        for at, r in enumerate(raw):
            if 2 <= len(r) <= 2 * LONGEST + 1:
                by_width.setdefault(1 << (len(r) - 2).bit_length(), []).append(at)
            else:
                out[at] = one(pieces[at])
        for width, members in by_width.items():
            for a in range(0, len(members), MOST):
                part = members[a : a + MOST]
                found = grown([raw[x] for x in part], width) if len(part) >= FEWEST else [one(pieces[x]) for x in part]
                for at, ids in zip(part, found, strict=True):
                    out[at] = ids
        return out

    return encode


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with the column as its last."""
    kept = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), values], names=[*(batch.schema.names[i] for i in kept), name])


def _encoding(model: Model, text: str, ids: str, keep_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, cut = memo_for("encode", model, piece_encoder), model.cut()
    store = kept_by("encode")
    if "forest" not in store:
        store["forest"] = forest_encoder(model)
    together = store["forest"]
    for batch in slices(batches, rows=ENCODED_AT_ONCE, owner="encode", column=text):
        pieces = [cut(t) if t else () for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        memo.learn(chain.from_iterable(pieces), together)
        found = [b"".join(map(memo.__getitem__, p)) for p in pieces]
        ends = np.cumsum([0] + [len(f) // 4 for f in found])
        values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32)))
        out = _replaced(batch, ids, values)
        yield out if keep_text else out.drop_columns([text])


def _decoding(pieces: dict[int, bytes], ids: str, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    buffer = np.frombuffer(b"".join(table), np.uint8)
    length = np.array([len(p) for p in table] + [0])
    start = np.concatenate(([0], np.cumsum(length)))[:-1]
    for batch in slices(batches, owner="encode"):
        lists = batch.column(batch.schema.get_field_index(ids))
        texts: list[str] = []
        for a in range(0, len(lists), DECODED_AT_ONCE):
            part = lists.slice(a, DECODED_AT_ONCE)
            values = part.flatten().fill_null(-1).to_numpy()
            values = np.where((values < 0) | (values >= len(table)), len(table), values)
            sizes = length[values]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            data = buffer[np.arange(ends[-1]) + np.repeat(start[np.minimum(values, len(table) - 1)] - ends[:-1], sizes)].tobytes()
            counts = np.fromiter((len(x) if x.is_valid else 0 for x in part), np.int64, len(part))
            cuts = ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
            texts += [data[x:y].decode("utf-8", "replace") for x, y in zip(cuts, cuts[1:], strict=False)]
        yield _replaced(batch, text, pa.array(texts, pa.string()))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """df with the array<int> column ``ids`` of each text; without the text if keep_text is false."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary))
    return df.mapInArrow(lambda batches: _encoding(shared.value, text, ids, keep_text, batches), _encoded(df.schema, text, ids, keep_text))


def _encoded(schema: T.StructType, text: str, ids: str, keep_text: bool) -> T.StructType:
    out = _with(schema, ids, T.ArrayType(T.IntegerType()))
    return out if keep_text else T.StructType([f for f in out.fields if f.name != text])


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the string column ``text`` that the ids stand for."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary).pieces)
    return df.mapInArrow(lambda batches: _decoding(shared.value, ids, text, batches), _with(df.schema, text, T.StringType()))


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep_text: bool = True) -> DataFrame:
    """encode, then decode from the ids, in one task: the ids cross to the JVM once."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _decoding(shared.value.pieces, ids, decoded, _encoding(shared.value, text, ids, keep_text, batches))

    return df.mapInArrow(run, _with(_encoded(df.schema, text, ids, keep_text), decoded, T.StringType()))

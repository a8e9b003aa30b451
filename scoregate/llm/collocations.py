"""Collocations: phrases that stand together more often than their parts would by chance, in each language.

Method: texts are cut into shards where they are read. A shard numbers its words and holds them as one sequence, with a mark between
pieces (a phrase never runs over a mark). Its index is the Burrows-Wheeler transform of that sequence and of its reverse,
sorted as deep as phrases are long. All intervals of one length are extended to the left at once: the transform's rows in
the order of their symbol are the rows of the longer phrases, so each run of (symbol, interval) there is an extended interval,
and its place within its parent gives the interval in the reversed index. Interval sizes are counts; how many rows of the two
transforms hold a word says how often a word stands before and after. Counts are summed over shards.

What can't matter isn't extended: a phrase counted at least `least` times has parts that are, so lengths are counted one after
another, and a shard extends only what a bit set of SIEVE_BITS bits of the length before lets through. The bit set knows no false
negatives and its false positives are counted like others, so it steers work and not results. Candidates get their parts' counts
by joins; the best of each language are found by salted ranks first.

Defined cases: a null language is `und`, a null text empty; pieces are cut at `[.,;:!?]`, line feed and the three after it, words at
space and tab alone; only A-Z are lowered; repeated rows count as often as they stand; a text of any length is counted
whole (a shard ends between pieces, and a longer piece is in one shard); a language without candidates has no rows; an
empty table gives an empty result; further columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from scoregate.llm.common import Scratch, mix64, ship, slices, text_chunks

#: Words of a shard, about; rows of a batch that a shard returns.
SHARD, ROWS = 1 << 21, 1 << 16
#: Bits of the set of what may be extended: 8 MB, whatever it holds.
SIEVE_BITS = 1 << 26
#: Parts that a language's candidates are ranked in before the best of each meet.
PARTS = 64

_WORD, _CUT = 0, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = _CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_and_pieces(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The lower-case words of a text column, a run of texts at a time, and for each whether it begins a piece."""
    for _, _, raw, at in text_chunks(column):
        data = np.frombuffer(raw, np.uint8)
        kind = _KIND[data]
        inside = kind == _WORD
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = at[:-1][at[:-1] < at[1:]]
        begins[heads] = inside[heads]
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        where = np.flatnonzero(inside)
        offsets = np.append(np.searchsorted(where, starts), len(where))
        letters = _LOWER[data[where]]
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters))
        piece = np.cumsum(kind == _CUT)[starts] + np.searchsorted(at, starts, "right")
        yield words, np.append(True, piece[1:] != piece[:-1])


def hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two words one after another."""
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)


@dataclass
class Sieve:
    """Bits of hashes; nothing that was put in is ever said to be absent."""

    held: np.ndarray  # unsigned 64-bit words

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        place = h % np.uint64(SIEVE_BITS)
        return (self.held[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


@dataclass
class Index:
    """The two transforms of a sequence of symbols (0 between pieces), sorted by the first `depth` symbols of each suffix, and where
    the rows of each first symbol begin."""

    bwt: np.ndarray
    reversed_bwt: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, sequence: np.ndarray, symbols: int, depth: int) -> Index:
        counts = np.bincount(sequence, minlength=symbols)
        return cls(_transform(sequence, symbols, depth), _transform(sequence[::-1], symbols, depth), np.append(0, np.cumsum(counts)))


def _transform(sequence: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """The symbol before each suffix, suffixes in the order of their first `depth` symbols; the sequence is a ring."""
    if symbols**depth < 1 << 62:
        key = sequence.astype(np.int64)
        for k in range(1, depth):
            key = key * symbols + np.roll(sequence, -k)
        order = np.argsort(key)
    else:
        order = np.lexsort([np.roll(sequence, -k) for k in reversed(range(depth))])
    return sequence[order - 1]


@dataclass
class Intervals:
    """Phrases of one length: their first symbol and the phrase that it was put before, rows [low, low + n) of the index, the first
    row of the reversed index, and how often a word stands before and after."""

    first: np.ndarray
    parent: np.ndarray
    low: np.ndarray
    n: np.ndarray
    reverse_low: np.ndarray
    before: np.ndarray | None = None
    after: np.ndarray | None = None

    def only(self, kept: np.ndarray) -> Intervals:
        pick = lambda x: None if x is None else x[kept]
        return Intervals(self.first[kept], self.parent[kept], self.low[kept], self.n[kept], self.reverse_low[kept], pick(self.before), pick(self.after))

    def counted(self, index: Index) -> Intervals:
        """With before and after."""
        before, after = (np.append(0, np.cumsum(t != 0)) for t in (index.bwt, index.reversed_bwt))
        self.before = before[self.low + self.n] - before[self.low]
        self.after = after[self.reverse_low + self.n] - after[self.reverse_low]
        return self


def single(index: Index, symbols: np.ndarray) -> Intervals:
    """The intervals of phrases of one symbol."""
    low = index.begin[symbols]
    return Intervals(symbols, np.full(len(symbols), -1), low, index.begin[symbols + 1] - low, low)


def extended(index: Index, found: Intervals, usual: np.ndarray, order: np.ndarray) -> Intervals:
    """All phrases of one symbol more to the left. usual: which symbols are words to extend by; order: the rows of the transform
    in the order of their symbol."""
    rows = len(index.bwt)
    ident = np.full(rows, -1, np.int64)
    where = np.repeat(found.low - np.append(0, np.cumsum(found.n)[:-1]), found.n) + np.arange(found.n.sum())
    ident[where] = np.repeat(np.arange(len(found.n)), found.n)
    symbol, of = index.bwt[order], ident[order]
    edge = np.flatnonzero(np.append(True, (symbol[1:] != symbol[:-1]) | (of[1:] != of[:-1])))
    size = np.diff(np.append(edge, rows))
    symbol, of = symbol[edge], of[edge]
    live = of >= 0
    symbol, of, edge, size = symbol[live], of[live], edge[live], size[live]
    by_parent = np.lexsort((symbol, of))
    upto = np.cumsum(size[by_parent])
    fresh = np.append(True, of[by_parent][1:] != of[by_parent][:-1])[: len(upto)]
    base = (upto - size[by_parent])[fresh]
    smaller = np.empty(len(size), np.int64)
    smaller[by_parent] = upto - size[by_parent] - np.repeat(base, np.diff(np.append(np.flatnonzero(fresh), len(upto))))
    out = Intervals(symbol, of, edge, size, found.reverse_low[of] + smaller)
    return out.only(usual[symbol])


def single_words(codes: np.ndarray, fresh: np.ndarray, symbols: int) -> Intervals:
    """What the intervals of single words count."""
    n, before = (np.bincount(codes[kept], minlength=symbols)[1:] for kept in (slice(None), ~fresh))
    after = np.bincount(codes[:-1][~fresh[1:]], minlength=symbols)[1:]
    none = np.zeros(len(n), np.int64)
    return Intervals(np.arange(1, symbols), none - 1, none, n, none, before, after)


class Shard:
    """Words of one language until they are indexed and counted."""

    def __init__(self, lang: str):
        self.lang, self.words, self.fresh, self.size = lang, [], [], 0

    def add(self, words: pa.Array, fresh: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Takes words; gives what is full, cut where a piece begins."""
        at = 0
        while len(words) - at > SHARD - self.size:
            end = at + SHARD - self.size
            heads = np.flatnonzero(fresh[end:])
            end = end + int(heads[0]) if len(heads) else len(words)
            self._push(words.slice(at, end - at), fresh[at:end])
            yield self.take()
            at = end
        self._push(words.slice(at), fresh[at:])

    def _push(self, words: pa.Array, fresh: np.ndarray) -> None:
        if len(words):
            self.words.append(words)
            self.fresh.append(fresh)
            self.size += len(words)

    def take(self) -> tuple[pa.Array, np.ndarray]:
        out = pa.concat_arrays(self.words).dictionary_encode(), np.concatenate(self.fresh)
        self.words, self.fresh, self.size = [], [], 0
        return out


def phrases_of(words: pa.DictionaryArray, fresh: np.ndarray, lang: str, length: int, sieve: Sieve | None) -> Iterator[tuple[pa.Array, Intervals]]:
    """The phrases of one length in a shard with their intervals. sieve: of the phrases that are one word shorter."""
    codes, names = words.indices.to_numpy() + np.int32(1), words.dictionary
    rare = len(names) + 1
    if length == 1:  # a word's rows are all of its places: no index is needed to count them
        alone = single_words(codes, fresh, rare)
        for at in range(0, len(names), ROWS):
            yield names.slice(at, ROWS), alone.only(np.arange(at, min(at + ROWS, len(names))))
        return
    usual = np.ones(rare + 1, bool)
    usual[[0, rare]] = False
    own = np.zeros(rare + 1, np.uint64)
    if sieve is not None:
        own[1:rare] = hashes([n.as_buffer().to_pybytes() for n in names], lang)
        if length == 2:
            usual[1:rare] = sieve.may_hold(own[1:rare])
            codes = np.where(usual[codes], codes, np.int32(rare))
    sequence = np.zeros(len(codes) + int(fresh.sum()) + 1, np.int32)
    sequence[np.arange(len(codes)) + np.cumsum(fresh)] = codes
    index = Index.of(sequence, rare + 1, length)
    steps = [single(index, np.flatnonzero(usual & (np.diff(index.begin) > 0)))]
    order = np.argsort(index.bwt, kind="stable")
    while len(steps) < length and len(steps[-1].n):
        if len(steps) == 2:
            a, b = steps[1].first, steps[0].first[steps[1].parent]
            steps[1] = steps[1].only(sieve.may_hold(joined(own[a], own[b])))
        longer = extended(index, steps[-1], usual, order)
        if len(steps) == 2:
            longer = longer.only(sieve.may_hold(joined(own[longer.first], own[steps[1].first[longer.parent]])))
        steps.append(longer)
    last = steps[-1].counted(index)
    if len(steps) < length:
        return
    for at in range(0, len(last.n), ROWS):
        piece = last.only(np.arange(at, min(at + ROWS, len(last.n))))
        said, parent, k = [names.take(pa.array(piece.first - 1))], piece.parent, length - 2
        while k >= 0:
            said.append(names.take(pa.array(steps[k].first[parent] - 1)))
            parent, k = steps[k].parent[parent], k - 1
        yield pc.binary_join_element_wise(*said, pa.scalar(" ", pa.large_string())) if len(said) > 1 else said[0], piece


_COUNTS = "lang string, phrase string, n long, n_before long, n_after long"


def counted(documents: DataFrame, length: int, least: int, sieve: Sieve | None, scratch: Scratch) -> DataFrame:
    """(lang, phrase, n, n_before, n_after) of the phrases of one length that are found `least` times or more, and for length 1 a row
    with a null phrase for each language, whose n counts all its words."""
    shared = documents.sparkSession.sparkContext.broadcast(sieve)

    def told(lang: str, full: tuple[pa.Array, np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, fresh = full
        for phrases, found in phrases_of(words, fresh, lang, length, shared.value):
            numbers = [pa.array(x, pa.int64()) for x in (found.n, found.before, found.after)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(phrases), pa.string()), phrases.cast(pa.string()), *numbers],
                names=["lang", "phrase", "n", "n_before", "n_after"]
            )
        if length == 1:
            yield pa.RecordBatch.from_pylist([{"lang": lang, "phrase": None, "n": len(words), "n_before": 0, "n_after": 0}], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        for batch in slices(batches, owner="collocations", column="text"):
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                shard = shards.setdefault(lang, Shard(lang))
                texts = batch.column("text").filter(pc.equal(langs, lang))
                for words, fresh in words_and_pieces(texts):
                    for full in shard.add(words, fresh):
                        yield from told(lang, full)
        for lang, shard in shards.items():
            if shard.size:
                yield from told(lang, shard.take())

    asked = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    parts = asked.mapInArrow(run, _COUNTS)
    # Dealt out as they come: a shard gives each phrase once, so summing before the shuffle would only fill memory.
    sums = parts.repartition("lang", "phrase").groupBy("lang", "phrase").agg(*(F.sum(c).alias(c) for c in ("n", "n_before", "n_after")))
    return scratch.table(sums.where((F.col("n") >= least) | F.col("phrase").isNull()), f"phrases-{length}")


_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("n_before", pa.int64()), ("n_after", pa.int64())])


def sieve_of(phrases: DataFrame, length: int) -> Sieve:
    """The bit set of the phrases of a table; it comes to the driver as at most SIEVE_BITS / 64 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=ROWS):
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = [p.encode() for p in batch.column("phrase").filter(pc.equal(batch.column("lang"), lang)).to_pylist()]
                h = hashes([p.split(b" ")[0] for p in own], lang)
                if length == 2:
                    h = joined(h, hashes([p.split(b" ")[1] for p in own], lang))
                place = h % np.uint64(SIEVE_BITS)
                bits = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(bits)], names=["word", "bits"])

    found = phrases.where("phrase is not null").select("lang", "phrase").mapInArrow(run, "word long, bits long")
    held = np.zeros(SIEVE_BITS >> 6, np.uint64)
    rows = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Sieve(held)


def _score(l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), exactly: counts of up to 15 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(F.col("a")) * wide(F.col("a")) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))


def collocations(documents: DataFrame, least: int = 10, covered_percent: int = 50, most: int | None = 2000) -> DataFrame:
    """The phrases of 2 and 3 words of each language that are found `least` times or more, best first: lang, rank, phrase, a (its
    count), l and r (those of the parts of its worst cut), n (words of the language), score, n_before and n_after (how many of
    its places have a word before or after them). A phrase within a longer one that is found `covered_percent` percent as often is
    left out. most: rows of a language, None for all without a rank."""
    ship(documents.sparkSession)
    scratch = Scratch(documents.sparkSession)
    singles = counted(documents, 1, least, None, scratch)
    pairs = counted(documents, 2, least, sieve_of(singles, 1), scratch)
    triples = counted(documents, 3, least, sieve_of(pairs, 2), scratch)
    words = singles.where("phrase is not null")

    def looked_up(df: DataFrame, counts: DataFrame, part: str) -> DataFrame:
        return df.join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(f"n_{part}")), ["lang", part])

    own = ["lang", "phrase", F.col("n").alias("a"), "n_before", "n_after"]
    word = lambda i: F.split_part("phrase", F.lit(" "), F.lit(i))
    two = pairs.select(*own, word(1).alias("first"), word(2).alias("last"))
    two = looked_up(looked_up(two, words, "first"), words, "last").select(
        *own[:2],
        "a",
        *own[3:],
        F.col("n_first").alias("l"),
        F.col("n_last").alias("r"),
        _score(F.col("n_first"), F.col("n_last")).alias("score")
    )
    three = triples.select(
        *own,
        word(1).alias("first"),
        word(3).alias("last"),
        F.concat_ws(" ", word(1), word(2)).alias("head"),
        F.concat_ws(" ", word(2), word(3)).alias("tail")
    )
    three = looked_up(looked_up(looked_up(looked_up(three, pairs, "head"), pairs, "tail"), words, "first"), words, "last")
    three = scratch.table(
        three.withColumn(
            "cut1", _score(F.col("n_first"), F.col("n_tail"))
        ).withColumn("cut2", _score(F.col("n_head"), F.col("n_last"))),
        "three"
    )
    early = F.col("cut1") <= F.col("cut2")
    best = lambda a, b: F.when(early, F.col(a)).otherwise(F.col(b))
    covering = lambda part: three.where(100 * F.col("a") >= covered_percent * F.col(f"n_{part}")).select("lang", F.col(part).alias("phrase"))
    two = two.join(covering("head").unionByName(covering("tail")).distinct(), ["lang", "phrase"], "left_anti")
    out = two.unionByName(
        three.select(
            *own[:2],
            "a",
            *own[3:],
            best("n_first", "n_head").alias("l"),
            best("n_tail", "n_last").alias("r"),
            best("cut1", "cut2").alias("score")
        )
    )
    if most is not None:
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)
        out = ranked(ranked(out.withColumn("part", part), "part").drop("rank", "part"))
    totals = singles.where("phrase is null").select("lang", "n")
    return out.join(totals, "lang").select("lang", *(["rank"] if most is not None else []), "phrase", "a", "l", "r", "n", "score", "n_before", "n_after")

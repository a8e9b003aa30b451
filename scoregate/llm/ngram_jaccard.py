"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least 0.8, and their groups.

Method: a size-aware heavy-light join. All sets share one token order (rare shingles first). A light set, one of at most
``boundary`` shingles, is listed under every two-token subset of its extended prefix; a heavy set is listed under each
token of its prefix, so that its partners are found by scanning those inverted lists. Light sets large enough to have a
heavy partner stand in both. The boundary is the size with the lowest estimated cost, from the sizes and list lengths
that the first pass meets.

Exactness: with overlap at least a = ceil(4n/5) needed by a set of n shingles, the first n - a + 1 tokens of two linked
sets share a token and the first n - a + 2 share two, whatever the order. The order therefore only decides the speed:
shingles met often come last, by the count of a bounded table (HOT_LIMIT entries, 16 bytes each) that is broadcast.

Groups: equal sets are one class. Instead of all pairs of a list, a list first links its members to one pivot; verified
links make components, and only lists that still hold different components are then compared between components: each
member outside the list's largest component with all others, members of the largest never with each other. Each link
between different components is verified on the full sets, so that no link which could join two components is lost, while
a group of thousands of near copies costs a multiple of its size and not its square. A set travels once to each pair as
its smaller partner or once to its own key; the join by pivot writes nothing but links and keeps no partitioning, so that
Spark may split the pivot of a large group.

Shingles and sets are known by 64-bit hashes. Defined cases: a null or empty text, or one without words, has no shingles,
its component is its own doc_id; a text of fewer than five words has its whole sequence as one shingle; repeated rows
and rows with a null doc_id stay, each with the smallest non-null doc_id of its group (null if there is none); further
columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from scoregate.llm.common import EDGES_A_FILE, Scratch, connected_components, mix64, ship, slices, text_chunks, window_hashes, word_hashes

N = 5
#: Entries of the broadcast table of frequent shingles, at most.
HOT_LIMIT = 100_000
#: A shingle counts as frequent from this many sets.
HOT_FROM = 24
#: Shingles counted at a time within a task, and the count from which a shingle is reported.
CHUNK, REPORT_FROM = 1_000_000, 5
#: Bits of the broadcast filter of class ids.
FILTER_BITS = 1 << 25
#: Sizes up to which two-token subsets may be listed.
BOUNDARIES = (0, 5, 10, 20, 40, 64)
#: Longs of the short bitmap, and how many of its preceding lists an entry names.
FOLD, BEFORE = 8, 3
_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, n: int = N) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its n-word shingles) of every row of a string column."""
    for row, end, raw, at in text_chunks(column):
        h, bounds = word_hashes(raw.lower(), at)
        windows = window_hashes(h, n) if len(h) >= n else np.empty(0, np.uint64)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            own = windows[a : b - n + 1] if b - a >= n else window_hashes(h[a:b], b - a) if b > a else h[:0]
            if len(own) > 1:
                own = np.sort(own)
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield row + i, own


def set_id(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens by their low bits, at least one bit for each token: two sets differ in at least as many
    tokens as their bitmaps do in bits."""
    width = 1 << max(9, (len(tokens) - 1).bit_length())
    odd = (np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _folded(bitmap: np.ndarray) -> np.ndarray:
    """The same bitmap over 512 bits."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, FOLD))


def prefix_length(n: int) -> int:
    """How many of the first tokens of a set of n must share one with any linked set."""
    return n - -(-4 * n // 5) + 1


SUMMARY = "kind int, doc_id long, n long, id long, bitmap array<long>, folded array<long>"


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: a document with its set's id, size and bitmap. Kind 1: a shingle met often, with its count.
    Kind 2: for the sizes that may be light, how many sets and how many list entries their prefixes would scan."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    schema = pa.schema(zip(("kind", "doc_id", "n", "id", "bitmap", "folded"), kinds, strict=True))

    def rows(kind, doc_ids, ns, ids, bitmaps=None):
        def lists(values):
            ends = np.concatenate(([0], np.cumsum([len(b) for b in values]))) if values else np.zeros(len(ns) + 1)
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))

        maps = [lists(bitmaps), lists([_folded(b) for b in bitmaps or ()])]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * len(ns), pa.int32()),
                pa.array(doc_ids, pa.int64()),
                pa.array(ns, pa.int64()),
                pa.array(ids, pa.int64()),
                *maps
            ],
            schema=schema
        )

    seen: set[int] = set()
    held: list[np.ndarray] = []
    pending = 0

    def flush():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= REPORT_FROM
        yield rows(1, [None] * int(often.sum()), counts[often].tolist(), values[often].view(np.int64))
        light = [s for s in held if len(s) <= BOUNDARIES[-1]]
        if light:
            sizes = np.array([len(s) for s in light])
            scanned = np.array([counts[np.searchsorted(values, s[: prefix_length(len(s))])].sum() for s in light])
            for size in np.unique(sizes):
                yield rows(2, [int(size)], [int((sizes == size).sum())], [int(scanned[sizes == size].sum())])

    for batch in slices(batches, column=1):
        sizes, ids, bitmaps = [], [], []
        for _, s in shingle_sets(batch.column(1)):
            i = set_id(s)
            sizes.append(len(s))
            ids.append(i)
            bitmaps.append(_bitmap(s))
            if len(s) and i not in seen:
                seen.add(i)
                held.append(s)
                pending += len(s)
                if pending >= CHUNK:
                    yield from flush()
                    held, pending = [], 0
        if sizes:
            yield rows(0, batch.column(0), sizes, ids, bitmaps)
    if held:
        yield from flush()


def choose_boundary(light: dict[int, tuple[int, int]]) -> int:
    """The size up to which sets are light. light: size -> (sets, list entries that their prefixes would scan). A listed
    key costs as much as a scanned entry; sets from four fifths of the boundary on stand in both kinds of list."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, (sets, scanned) in light.items():
            width = prefix_length(n) + 1
            if n <= boundary:
                total += sets * max(1, width * (width - 1) // 2)
            if 5 * n > 4 * boundary:
                total += sets * prefix_length(n) + scanned
        return total

    return min(BOUNDARIES, key=lambda b: (cost(b), b))


def _lists(hot: tuple[np.ndarray, np.ndarray], boundary: int):
    """The task that writes the lists' entries: key, id, n, and whether the entry also counts for the smaller set."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("first", pa.bool_()), ("place_in_set", pa.int32())])
    hot_tokens, hot_counts = hot
    maybe = np.zeros(1 << 22, bool)
    maybe[hot_tokens & np.uint64(len(maybe) - 1)] = True

    def ordered(s: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(maybe[s & np.uint64(len(maybe) - 1)])
        if len(near):
            at = np.minimum(np.searchsorted(hot_tokens, s[near]), len(hot_tokens) - 1)
            count = np.zeros(len(s), np.int64)
            count[near] = np.where(hot_tokens[at] == s[near], hot_counts[at], 0)
            return s[np.argsort(count, kind="stable")]
        return s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, column=0):
            keys, ids, sizes, first, places = [], [], [], [], []

            def put(k: np.ndarray, i: int, n: int, firsts: int, keys=keys, ids=ids, sizes=sizes, first=first, places=places):
                keys.append(k)
                ids.append(np.full(len(k), i, np.int64))
                sizes.append(np.full(len(k), n, np.int64))
                first.append(np.arange(len(k)) < firsts)
                places.append(np.arange(len(k), dtype=np.int32))

            for _, s in shingle_sets(batch.column(0)):
                n, i = len(s), set_id(s)
                if not n or i in seen:
                    continue
                seen.add(i)
                s = ordered(s)
                if n <= boundary:
                    head = s[: prefix_length(n) + 1]
                    if len(head) < 2:
                        pairs = mix64(head ^ _MUL)
                    else:
                        a, b = np.triu_indices(len(head), 1)
                        lo, hi = np.minimum(head[a], head[b]), np.maximum(head[a], head[b])
                        pairs = mix64(lo * _MUL ^ mix64(hi))
                    put(pairs, i, n, len(pairs))
                if 5 * n > 4 * boundary:
                    put(s[: prefix_length(n)], i, n, n - -(-8 * n // 9) + 1)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.concatenate(ids)),
                        pa.array(np.concatenate(sizes)),
                        pa.array(np.concatenate(first)),
                        pa.array(np.concatenate(places))
                    ],
                    schema=schema
                )

    return run


def _sets(bits: np.ndarray):
    """The task that gives the whole sets of the documents that the filter may hold, each set once."""
    schema = pa.schema([("place", pa.int64()), ("id", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, column=1):
            at = batch.column(0).to_numpy() & (FILTER_BITS - 1)
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            places, ids, sets = [], [], []
            for place, (_, s) in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                found = place, set_id(s)
                if found not in seen:
                    seen.add(found)
                    places.append(found[0])
                    ids.append(found[1])
                    sets.append(s)
            if sets:
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(places, pa.int64()),
                        pa.array(ids, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                    ],
                    schema=schema
                )

    return run


def _place(doc_id):
    """A document's place, of which the filter takes the low bits; rows without a doc_id share one."""
    return F.xxhash64(doc_id)


def _document_filter(places: DataFrame) -> np.ndarray:
    """A bit set of the places of some documents: FILTER_BITS bits whatever their number. Others may share a place."""
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    low = F.col("place").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = places.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63L as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def _may_link():
    """Neither the sizes of the sets x and y nor their bitmaps rule the link out. Sizes that may link differ by a quarter
    at most, so one bitmap is at most twice as long as the other and is folded once."""
    both = F.col("x.n") + F.col("y.n")
    xor = lambda p, q: p.bitwiseXOR(q)

    def folded(own, other):
        half = (F.size(own) / 2).cast("int")
        return F.when(F.size(own) > F.size(other), F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), xor)).otherwise(own)

    x, y = F.col("x.bitmap"), F.col("y.bitmap")
    differing = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    sizes = 5 * F.least("x.n", "y.n") >= 4 * F.greatest("x.n", "y.n")
    least = F.expr("(4 * (x.n + y.n) + 8) div 9")
    return F.when(sizes, differing <= both - 2 * least).otherwise(False)


#: What verification needs of a pair of sets x and y.
_PAIR = ("x.id as a", "y.id as b", "x.n as na", "y.n as nb", "x.place as pa", "y.place as pb")


def _verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs (columns of _PAIR) whose whole sets are similar enough, as (src, dst). The sets of b, of which there are
    many, meet the pairs first; those of a, the pivots, are then repeated by Spark only where a pivot's pairs are split."""
    kept = scratch.table(pairs, "pairs")
    bits = _document_filter(kept.select(F.col("pa").alias("place")).unionByName(kept.select(F.col("pb").alias("place"))))
    if not bits.any():
        return kept.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    sets = docs.select(_place(F.col("doc_id")).alias("place"), "text").mapInArrow(lambda it: _sets(shared.value)(it), "place long, id long, tokens array<long>")
    sets = scratch.table(sets, "sets")
    return (
        kept.join(sets.select(F.col("id").alias("b"), F.col("place").alias("pb"), F.col("tokens").alias("tb")), ["b", "pb"])
        .join(sets.select(F.col("id").alias("a"), F.col("place").alias("pa"), F.col("tokens").alias("ta")), ["a", "pa"])
        .where(9 * F.size(F.array_intersect("ta", "tb")) >= 4 * (F.col("na") + F.col("nb")))
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
    )


def ngram_jaccard_groups(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; see the module's text."""
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summary = scratch.table(docs.mapInArrow(_summarise, SUMMARY), "summary")
    rows = summary.where("kind = 0")
    # A class is its set's id; its place is that of one of its documents.
    classes = rows.where("n > 0").groupBy("id").agg(
        F.any_value("n").alias("n"),
        F.any_value("bitmap").alias("bitmap"),
        F.any_value("folded").alias("folded"),
        F.min(_place(F.col("doc_id"))).alias("place"),
        F.min("doc_id").alias("least")
    )
    classes = scratch.table(classes, "classes")

    often = summary.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_FROM)
    often = often.orderBy(F.desc("n"), "id").limit(HOT_LIMIT).collect()
    tokens = np.array([r["id"] for r in often], np.int64).view(np.uint64)
    by_token = np.argsort(tokens)
    hot = (tokens[by_token], np.array([r["n"] for r in often], np.int64)[by_token])
    light = summary.where("kind = 2").groupBy("doc_id").agg(F.sum("n").alias("sets"), F.sum("id").alias("scanned")).collect()
    boundary = choose_boundary({r["doc_id"]: (r["sets"], r["scanned"]) for r in light})

    shared = spark.sparkContext.broadcast((hot, boundary))
    entries = docs.select("text").mapInArrow(
        lambda it: _lists(*shared.value)(it), "key long, id long, n long, first boolean, place_in_set int"
    ).repartition("key")
    # One shuffle serves both sides, as the entries are dealt by key and the grouped side reads the same columns.
    ends = entries.groupBy("key").agg(
        F.min("id").alias("pivot"), F.max("id").alias("last"), F.max(F.struct("n", "first", "place_in_set")).alias("most")
    ).where("pivot < last and most is not null")
    live = scratch.table(entries.join(ends, "key").select("key", "id", "n", "first", "place_in_set", "pivot"), "lists")

    pairs = live.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = connected_components(_verified(_possible(pairs, classes), docs, scratch), scratch)
    mixed = _mixed(live, stars, scratch)

    # Entries carry short bitmaps and the lists that stand just before in their set's order: a list gives only pairs that
    # the bitmaps don't rule out, and not those that a list before is known to give.
    brief = classes.select("id", *(F.col("folded")[i].alias(f"b{i}") for i in range(FOLD)))
    order = Window.partitionBy("id").orderBy("place_in_set", "key")
    before = F.array(*(F.lag("key", k).over(order) for k in range(1, BEFORE + 1)))
    entries = mixed.join(brief, "id").withColumn("before", F.array_compact(before)).drop("place_in_set")
    # Members of a list's main component meet only those of others.
    smaller = entries.where("first").withColumn(
        "other_main", F.explode(F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    )
    apart = F.expr("x.root <> y.root and (x.n > y.n or x.n = y.n and x.id > y.id) and 5 * y.n >= 4 * x.n")
    differing = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(FOLD)])
    near = differing <= F.expr("x.n + y.n - 2 * ((4 * (x.n + y.n) + 8) div 9)")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.main") == F.col("y.other_main"))
    pairs = entries.alias("x").join(smaller.alias("y"), meet & apart & near & ~F.expr("arrays_overlap(x.before, y.before)"))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    links = _verified(_possible(pairs, classes), docs, scratch)
    roots = connected_components(links.unionByName(stars.select(F.col("node").alias("src"), F.col("root").alias("dst"))), scratch)

    # The smallest doc_id of each component from its linked classes, written, so that the join back may be split where a component
    # is large; then one row for each class to meet the documents.
    linked = roots.select(F.col("node").alias("id"), "root").join(classes.select("id", "least"), "id")
    smallest = scratch.table(linked.groupBy("root").agg(F.min("least").alias("component")).coalesce(1 + roots.count() // EDGES_A_FILE), "smallest")
    known = roots.join(smallest, "root").select(F.col("node").alias("id"), "component")
    known = scratch.table(
        classes.select("id", "least").join(known, "id", "left").select("id", F.coalesce("component", "least").alias("component")),
        "components"
    )
    return rows.select("doc_id", "n", "id").join(known, "id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that their sizes and bitmaps don't rule out, with the columns of _PAIR."""
    pairs = pairs.join(classes.alias("x"), F.col("a") == F.col("x.id")).join(classes.alias("y"), F.col("b") == F.col("y.id"))
    return pairs.where(_may_link()).selectExpr(*_PAIR)


def _mixed(live: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """The entries of lists that hold more than one component, and whether they belong to the list's largest one."""
    live = live.drop("pivot").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    live = live.distinct().repartition("key")
    held = live.groupBy("key", "root").agg(F.count(F.lit(1)).alias("members"))
    lists = held.groupBy("key").agg(F.count(F.lit(1)).alias("components"), F.max(F.struct("members", "root"))["root"].alias("largest")).where("components > 1")
    return scratch.table(
        live.join(lists, "key").select(
            "key", "id", "n", "first", "place_in_set", "root", (F.col("root") == F.col("largest")).alias("main")
        ),
        "lists"
    )


def keep_one_of_each_group(documents: DataFrame) -> DataFrame:
    """The documents whose doc_id is the smallest of their group of near copies. Rows without a doc_id stay."""
    groups = ngram_jaccard_groups(documents).select("doc_id", "component_id").dropDuplicates(["doc_id"])
    copies = groups.where(F.col("component_id") < F.col("doc_id")).select("doc_id")
    return documents.join(copies, "doc_id", "left_anti").select(*documents.columns)

"""Mixing sources to target weights.

Method: documents are aggregated by their membership pattern, the set of sources they belong to. A min-cost flow over
patterns and sources (successive shortest paths) routes the patterns' words to the sources' quotas; a pattern may be used
``repeats`` times, each further time at a higher price, so that nothing is repeated while something fresh would do. Of a
pattern's routed words the whole multiples repeat all its documents; for the rest documents are taken in the order of a
seeded hash. The cut is found by counting words by hash range, then by the ranges within the one that holds it, and so on for
LEVELS levels, and then ordering only the last range, for large documents first and the smaller ones after, which fill what
the larger left; every document is then judged on its own against its pattern's cuts, by a broadcast table of a row for each
pattern and size class. The driver and that table hold a row for each pattern of memberships that occurs, not for documents;
the flow is meant for patterns by the thousand.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share all words; a target stops at
``repeats`` times its source's words and the excess is shared anew by weight.

Defined cases: a null text has 0 words; a null or empty membership counts as the source null; documents of 0 words are
taken 0 times; repeated rows share one decision; further columns stay in mixed_documents; empty tables give empty results."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from scoregate.llm.common import Scratch, word_count

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 17
#: Bits of the hash by which a range is split at each level, and how often: a last range holds a 65,536th of a pattern.
RANGE_BITS, LEVELS = 8, 2
#: Documents above these shares of their pattern's words are decided before the smaller ones.
CLASSES = (1 / 16, 1 / 256, 1 / 4096)


def targets(sizes: dict, weights=WEIGHTS, repeats: int = REPEATS, total: float | None = None) -> dict:
    """The target of each source, from the words of each (keys: names, None last)."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values()) if total is None else total), list(order), {}
    while open_:
        share = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / share > repeats * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / share for s in open_}
        for s in full:
            out[s] = float(repeats * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Words drawn from each pattern: a min-cost flow of the patterns' words (each usable `repeats` times, at prices that
    rise with each time) to the quotas of the sources they belong to."""
    ids = {("start",): 0, ("end",): 1}
    graph: list[list[int]] = [[], []]
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []

    def node(key) -> int:
        if key not in ids:
            ids[key] = len(graph)
            graph.append([])
        return ids[key]

    def arc(a: int, b: int, most: int, cost: int) -> None:
        for x, y, r, c in ((a, b, most, cost), (b, a, 0, -cost)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(c)

    drawn: dict[tuple, list[int]] = {}
    for pattern, words in sorted(patterns.items(), key=str):
        p = node(("pattern", pattern))
        drawn[pattern] = []
        for time in range(repeats):
            drawn[pattern].append(len(to))
            arc(0, p, words, time * (time + 1) // 2)
        for source in pattern:
            arc(p, node(("source", source)), repeats * words, 0)
    for source, quota in sorted(quotas.items(), key=str):
        arc(node(("source", source)), 1, round(quota), 0)
    while True:
        cost, through, queue, queued = [None] * len(graph), [-1] * len(graph), deque([0]), {0}
        cost[0] = 0
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for a in graph[x]:
                if room[a] > 0 and (cost[to[a]] is None or cost[x] + price[a] < cost[to[a]]):
                    cost[to[a]], through[to[a]] = cost[x] + price[a], a
                    if to[a] not in queued:
                        queued.add(to[a])
                        queue.append(to[a])
        if cost[1] is None:
            return {p: sum(room[a ^ 1] for a in arcs) for p, arcs in drawn.items()}
        path, x = [], 1
        while x:
            path.append(through[x])
            x = to[through[x] ^ 1]
        flow = min(room[a] for a in path)
        for a in path:
            room[a] -= flow
            room[a ^ 1] += flow


#: A pattern's name: the length and name of each source, so that no two patterns share one.
_NAME = "concat_ws(',', transform(members, s -> coalesce(concat(length(s), '=', s), '')))"


def _described(documents: DataFrame, members, seed: int) -> DataFrame:
    """documents with members (sorted, null last), pattern, words and place (their seeded hash as a range and a rest)."""
    own = F.array_sort(F.array_distinct(members))
    held = F.when(members.isNull() | (F.size(members) == 0), F.array(F.lit(None).cast("string"))).otherwise(own)
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return documents.select(
        "*", held.alias("members"), word_count(F.col("text").cast("string")).alias("words"), hashed.alias("place")
    ).withColumn("pattern", F.expr(_NAME))


def _range(level: int):
    """The number of a place's range at a level."""
    return F.shiftrightunsigned(F.col("place").bitwiseXOR(F.lit(-(2**63))), 64 - RANGE_BITS * level)


def _cuts(sized: DataFrame, wanted: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """The last document (place, doc_id) to take from each pattern so that about `wanted` words come together, and the words
    that then come together. sized: pattern, place, doc_id, words of the documents of one size class."""
    spark = sized.sparkSession
    schema = "pattern string, range long, before long, wanted long"
    edges = [(p, 0, 0, w) for p, w in wanted.items()]
    for level in range(LEVELS):
        edge = F.broadcast(spark.createDataFrame(edges, schema))
        inside = sized.withColumn(
            "range", _range(level) if level else F.lit(0).cast("long")
        ).join(edge, ["pattern", "range"]).withColumn("range", _range(level + 1))
        by_range = inside.groupBy("pattern", "range", "before", "wanted").agg(F.sum("words").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("pattern").orderBy("range"))
        cut = by_range.withColumn("ahead", upto - F.col("words")).where("ahead < wanted").groupBy("pattern").agg(
            F.max(F.struct("range", "ahead", "wanted")).alias("m")
        )
        edges = [(r["pattern"], *r["m"]) for r in cut.collect()]
        if not edges:
            return {}
    edge = F.broadcast(spark.createDataFrame(edges, schema))
    order = Window.partitionBy("pattern").orderBy("place", "doc_id")
    inside = sized.withColumn("range", _range(LEVELS)).join(edge, ["pattern", "range"]).withColumn("upto", F.col("before") + F.sum("words").over(order))
    near = inside.where("2 * upto - words <= 2 * wanted").groupBy("pattern").agg(
        F.max(F.struct("place", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "upto")).alias("m")
    )
    found = {r["pattern"]: (r["m"]["place"], r["m"]["doc_id"], r["m"]["upto"]) for r in near.collect()}
    # Where no document of the range at the cut is taken, the ranges below it are.
    return {p: found.get(p, (_range_start(range_) - 1, 2**63 - 1, before)) for p, range_, before, _ in edges}


def _range_start(range_: int) -> int:
    return (range_ << (64 - RANGE_BITS * LEVELS)) - 2**63


def decide(sized: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> tuple[Callable[[DataFrame], DataFrame], dict, dict]:
    """(a function that adds the column copies to a table of doc_id, pattern, place and words, words of each source, target of each
    source). sized: doc_id, members, pattern, place and words of every document, in a table that is read several times."""
    spark = sized.sparkSession
    groups = sized.groupBy("pattern").agg(F.any_value("members").alias("members"), F.sum("words").alias("words")).collect()
    patterns = {tuple(r["members"]): r["words"] for r in groups}
    sizes: dict = {}
    for pattern, words in patterns.items():
        for source in pattern:
            sizes[source] = sizes.get(source, 0) + words
    quotas = targets(sizes, weights, repeats, total=sum(patterns.values()))
    routed = route(patterns, quotas, repeats)
    names = {tuple(r["members"]): r["pattern"] for r in groups}
    copies = {names[p]: routed[p] // words if words else 0 for p, words in patterns.items()}
    rest = {names[p]: routed[p] - copies[names[p]] * words for p, words in patterns.items()}
    whole = {names[p]: words for p, words in patterns.items()}

    limits = F.broadcast(
        spark.createDataFrame(
            [(n, *(int(w * c) for c in CLASSES)) for n, w in whole.items()],
            "pattern string, " + ", ".join(f"c{i} long" for i in range(len(CLASSES)))
        )
    )
    klass = F.lit(len(CLASSES))
    for i in reversed(range(len(CLASSES))):
        klass = F.when(F.col("words") > F.col(f"c{i}"), i).otherwise(klass)
    classed = sized.join(limits, "pattern").withColumn("class", klass).select("doc_id", "pattern", "place", "words", "class")
    held = {(r["pattern"], r["class"]): r["words"] for r in classed.groupBy("pattern", "class").agg(F.sum("words").alias("words")).collect()}
    left, table = dict(rest), []
    for i in range(len(CLASSES) + 1):
        smaller = {n: sum(held.get((n, k), 0) for k in range(i, len(CLASSES) + 1)) for n in whole}
        wanted = {n: round(left[n] * held[n, i] / smaller[n]) for n in whole if held.get((n, i)) and left[n] > 0}
        cuts = _cuts(classed.where(F.col("class") == i), wanted) if wanted else {}
        for n, (place, doc_id, words) in cuts.items():
            left[n] -= words
            table.append((n, i, place, doc_id))
    chosen = F.broadcast(spark.createDataFrame(table, "pattern string, class int, cut_place long, cut_id long"))
    always = F.broadcast(spark.createDataFrame(list(copies.items()), "pattern string, all_copies long"))

    def judged(described: DataFrame) -> DataFrame:
        key = F.struct(F.col("place"), F.coalesce("doc_id", F.lit(-(2**63))))
        out = described.join(limits, "pattern", "left").withColumn("class", klass).join(always, "pattern", "left").join(chosen, ["pattern", "class"], "left")
        extra = F.coalesce((key <= F.struct("cut_place", "cut_id")).cast("long"), F.lit(0))
        out = out.withColumn("copies", F.when(F.col("words") > 0, F.least(F.col("all_copies") + extra, F.lit(repeats))).otherwise(0).cast("long"))
        return out.select(*described.columns, "copies")

    return judged, sizes, quotas


def plan(documents: DataFrame, members, weights=WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> tuple[DataFrame, dict, dict]:
    """(documents with members, words and copies, words of each source, target of each source)."""
    described = _described(documents, members, seed)
    sized = Scratch(documents.sparkSession).table(described.select("doc_id", "members", "pattern", "place", "words"), "sizes")
    judged, sizes, quotas = decide(sized, weights, repeats)
    return judged(described).select(*documents.columns, "members", "words", "copies"), sizes, quotas


def mixed_sizes(documents: DataFrame, source: str = "source", weights=WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, each belonging to the one source of its column."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(source).cast("string").alias("_source"))
    described = _described(docs, F.array(F.col("_source")), seed).drop("text")
    sized = Scratch(spark).table(described, "sizes")  # the texts are read once
    judged, sizes, quotas = decide(sized, weights, repeats)
    known = spark.createDataFrame(
        [(s, sizes[s], quotas[s]) for s in sizes],
        T.StructType(
            [
                T.StructField("_source", T.StringType()),
                T.StructField("source_size", T.LongType()),
                T.StructField("target", T.DoubleType())
            ]
        )
    )
    known = F.broadcast(known.withColumnRenamed("_source", "_known"))
    return judged(sized).join(known, F.col("_source").eqNullSafe(F.col("_known")), "left").select(
        "doc_id", F.col("words").alias("size"), "source_size", "target", (F.col("words") * F.col("copies")).alias("taken")
    )


def mixed_documents(documents: DataFrame, source: str = "source", weights=WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken."""
    own = documents.columns
    renamed = documents.select(
        *(F.col(c).alias(f"own_{c}") for c in own),
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.col(source).cast("string").alias("_source")
    )
    out, _, _ = plan(renamed, F.array(F.col("_source")), weights, repeats, seed)
    repeated = out.where("copies > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*(F.col(f"own_{c}").alias(c) for c in own))

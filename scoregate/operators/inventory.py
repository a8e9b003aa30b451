"""Inventories: reconciliation, lineage, ordered digests, counts by kind, reachability.

Defined cases: null equals null in keys and facts; rows that one side alone has are reported and never dropped; empty tables
give empty results (lineage_intact one row, which is false); helper columns begin with ``__sg_``."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scoregate.functions import scalars as S
from scoregate.operators.prefix import null_safe_join
from scoregate.sources.stages import staged


def reconcile(expected: DataFrame, observed: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """What differs between two inventories: (key, diff_kind), one of missing, extra or the name of the first fact that differs.
    Keys are unique on each side."""
    a = expected.select(key, F.struct(*facts).alias("__sg_a"))
    b = observed.select(key, F.struct(*facts).alias("__sg_b"))
    kind = S.any_code(
        (F.col("__sg_b").isNull(), "missing"),
        (F.col("__sg_a").isNull(), "extra"),
        *((~F.col(f"__sg_a.{f}").eqNullSafe(F.col(f"__sg_b.{f}")), f) for f in facts)
    )
    return null_safe_join(a, b, [key], "full_outer").select(key, kind.alias("diff_kind")).where("diff_kind is not null")


def evidence(expected: DataFrame, observed: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """Each expected row with its verification: verified, absent or changed; nothing is dropped."""
    seen = observed.select(key, F.lit(True).alias("__sg_seen"), *(F.col(f).alias(f"__sg_o_{f}") for f in facts))
    same = F.lit(True)
    for f in facts:
        same = same & F.col(f).eqNullSafe(F.col(f"__sg_o_{f}"))
    state = F.when(F.col("__sg_seen").isNull(), "absent").when(same, "verified").otherwise("changed")
    return null_safe_join(expected, seen, [key], "left").withColumn("verification", state).select(*expected.columns, "verification")


def lineage_intact(recorded: DataFrame, observed: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: how many recorded digests are there and whether every one equals the observed one."""
    checked = evidence(recorded.select(key, digest), observed, key, [digest])
    return checked.agg(
        F.count(F.lit(1)).alias("input_count"),
        F.coalesce(F.bool_and(F.col("verification") == "verified"), F.lit(False)).alias("lineage_intact")
    )


def lineage_by(recorded: DataFrame, observed: DataFrame, key: str, digest: str, groups: list[str]) -> DataFrame:
    """lineage_intact for each group of recorded rows."""
    checked = evidence(recorded.select(key, digest, *groups), observed.select(key, digest), key, [digest])
    return checked.groupBy(*groups).agg(F.count(F.lit(1)).alias("input_count"), F.bool_and(F.col("verification") == "verified").alias("lineage_intact"))


def split_counts(rows: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Rows and distinct kinds of each combination of columns, null being a value."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(kind).alias("kinds"))


def case_clashes(rows: DataFrame, name: str) -> DataFrame:
    """Names that differ in case alone: folded, and how many spellings share it. `STRASSE` is `straße` and a final sigma is a sigma, while
    accents tell names apart."""
    return rows.where(F.col(name).isNotNull()).groupBy(S.folded(F.col(name)).alias("folded")).agg(
        F.count_distinct(name).alias("name_count")
    ).where("name_count > 1")


def state_presence(fits: DataFrame, states: DataFrame, key: str, digest: str) -> DataFrame:
    """Where fit status and stored state disagree: a good fit without the state of its digest, a failed one with a state, a stray."""
    joined = null_safe_join(
        fits.select(key, "fit_status", F.col(digest).alias("__sg_want")),
        states.select(key, F.col(digest).alias("__sg_got"), F.lit(True).alias("__sg_stored")),
        [key],
        "full_outer"
    )
    rule = S.any_code(
        (F.col("fit_status").isNull(), "stray_state"),
        ((F.col("fit_status") == "ok") & F.col("__sg_stored").isNull(), "state_missing"),
        ((F.col("fit_status") == "ok") & ~F.col("__sg_want").eqNullSafe(F.col("__sg_got")), "state_changed"),
        ((F.col("fit_status") != "ok") & F.col("__sg_stored").isNotNull(), "state_of_failed_fit"),
    )
    return joined.select(key, rule.alias("rule")).where("rule is not null")


def ordered_digest(lines: DataFrame, groups: list[str], order: str, line: Column, separator: str = "\n", digits: int = 2) -> DataFrame:
    """A digest of each group's lines in their order, in two levels, so that no task holds all lines: first of the lines that share
    the first digits of their key's hash, then of those digests in order."""
    cut = lines.withColumn("__sg_cut", F.substring(F.sha2(F.col(order).cast("string"), 256), 1, digits)).withColumn("__sg_line", line)
    text = F.expr(f"listagg(__sg_line, '{separator}') WITHIN GROUP (ORDER BY {order})")
    parts = cut.groupBy(*groups, "__sg_cut").agg(F.sha2(text, 256).alias("__sg_part"), F.count(F.lit(1)).alias("__sg_n"))
    whole = F.expr("listagg(concat(__sg_cut, ':', __sg_part), '\n') WITHIN GROUP (ORDER BY __sg_cut)")
    return parts.groupBy(*groups).agg(F.sha2(whole, 256).alias("digest"), F.sum("__sg_n").alias("line_count"))


def tree_line(path: Column, digest: Column, size: Column | None = None, separator: str = "\t") -> Column:
    """A line of a tree's digest: path and digest with a NUL or a tab between, and in the sized layout the bytes between them."""
    return F.concat_ws(separator, path, *([size.cast("string")] if size is not None else []), digest)


def flat_digest(lines: DataFrame, groups: list[str], order: str, line: Column) -> DataFrame:
    """SHA-256 over each group's newline-ended lines in their order, in constant memory: a group's rows come sorted to one task, which
    takes a running digest of them batch by batch, so that a group may be larger than any task's memory. Null lines are passed
    over; a group of them alone has a null digest."""
    sorted_lines = lines.select(*groups, F.col(order).alias("__sg_order"), F.concat(line, F.lit("\n")).alias("__sg_line"))
    dealt = sorted_lines.repartition(*groups) if groups else sorted_lines.repartition(1)
    schema = T.StructType([*(lines.schema[g] for g in groups), T.StructField("digest", T.StringType())])
    return dealt.sortWithinPartitions(*groups, "__sg_order").drop("__sg_order").mapInArrow(_running_digest(groups), schema)


def _running_digest(groups: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, digest, some = None, None, False

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*of, pa.array([digest.hexdigest() if some else None], pa.string())], names=[*groups, "digest"])

        for batch in batches:
            edge = np.zeros(batch.num_rows, bool)
            for name in groups:  # where a row's group isn't the one of the row before
                column = batch.column(batch.schema.get_field_index(name))
                a, b = column.slice(0, len(column) - 1), column.slice(1)
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                edge[1:] |= ~same.to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(edge).tolist()]
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if a == b:
                    continue
                own = [batch.column(batch.schema.get_field_index(g)).slice(a, 1) for g in groups]
                if of is None or any(x.to_pylist() != y.to_pylist() for x, y in zip(of, own, strict=True)):
                    if of is not None:
                        yield ended()
                    of, digest, some = own, sha256(), False
                text = batch.column(batch.num_columns - 1).slice(a, b - a).drop_null().cast(pa.large_string())
                if len(text):
                    some = True
                    _, offsets, data = text.buffers()
                    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
                    digest.update(memoryview(data)[at[0] : at[-1]])
        if of is not None:
            yield ended()

    return run


def totals(items: DataFrame, prefix: Column, size: str) -> DataFrame:
    """Items and bytes by prefix, with a grand total under null."""
    return items.withColumn("prefix", prefix).rollup("prefix").agg(F.count(F.lit(1)).alias("item_count"), F.sum(size).alias("byte_total"))


def array_inventory(arrays: DataFrame, kind: str, values: str) -> DataFrame:
    """Arrays by kind: count, elements, bytes of 32-bit elements, and whether all elements are finite."""
    ok = F.forall(values, lambda x: x.isNotNull() & S.finite(x.cast("double")))
    out = arrays.groupBy(kind).agg(
        F.count(F.lit(1)).alias("array_count"),
        F.sum(F.size(values)).cast("long").alias("element_count"),
        F.bool_and(ok).alias("all_finite")
    )
    return out.withColumn("byte_count", F.col("element_count") * 4)


def path_kind(path: Column) -> Column:
    """License, notice, attribution or native library, by the name of a file; null for others."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return S.any_code(
        (name.rlike(r"^(licen[sc]e|copying)"), "license"),
        (name.rlike(r"^notice"), "notice"),
        (name.rlike(r"^(authors|contributors|thirdparty)"), "attribution"),
        (name.rlike(r"\.(so(\.[0-9]+)*|dylib|dll|pyd)$"), "native"),
    )


def missing_nodes(roots: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Roots and ends of edges that the table of nodes doesn't have: (node, role), role being root, src or dst."""
    asked = roots.select("node", F.lit("root").alias("role")).unionByName(
        edges.select(F.col("src").alias("node"), F.lit("src").alias("role"))
    ).unionByName(edges.select(F.col("dst").alias("node"), F.lit("dst").alias("role")))
    return null_safe_join(asked.distinct(), nodes.select("node").distinct(), ["node"], "left_anti")


def closure(roots: DataFrame, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes reachable from the roots (column node) over edges (src, dst), with the fewest steps: (node, depth). With a table of nodes,
    a root or end of an edge that isn't among them is an error.

    Each round joins the frontier with the edges and keeps what is new, as a written table, until nothing is."""
    if nodes is not None and (missing := [r["node"] for r in missing_nodes(roots, edges, nodes).limit(5).collect()]):
        raise ValueError(f"nodes that aren't there: {missing}")
    reached = roots.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for depth in itertools.count(1):
        found = frontier.join(edges, F.col("node").eqNullSafe(F.col("src"))).select(F.col("dst").alias("node")).distinct()
        frontier = staged(null_safe_join(found, reached.select("node"), ["node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return reached
        reached = staged(reached.unionByName(frontier))


def roles(nodes: DataFrame, runtime: DataFrame, development: DataFrame) -> DataFrame:
    """Each node's role: runtime if reachable from the runtime roots, else development, else orphan."""
    r = runtime.select("node", F.lit(True).alias("__sg_r"))
    d = development.select("node", F.lit(True).alias("__sg_d"))
    return null_safe_join(null_safe_join(nodes.select("node"), r, ["node"], "left"), d, ["node"], "left").select(
        "node",
        F.when(F.col("__sg_r").isNotNull(), "runtime").when(
            F.col("__sg_d").isNotNull(), "development"
        ).otherwise("orphan").alias("role")
    )

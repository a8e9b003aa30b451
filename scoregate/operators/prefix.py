"""Exact ranks and running sums of few groups with many rows, without one task for each group.

Rows are cut into ranges by splitters over (value, ties, row), taken from a sample of each large group, so that a value that most
rows share is cut as any other. Ranges are counted, the few counts are accumulated, and only what is accumulated inside a range
needs its rows together. The splitters decide the balance alone: of N rows a range has about N / RANGES, and with SAMPLE rows drawn
for them hardly ever more than three times as many. What is read more than once is written once.

Defined cases for all functions: null group keys are a group of their own; null values come first in ascending order (and
in a range of their own); an empty table gives an empty result; the columns that they add and drop begin with ``__sg_``,
so that other names can't clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from scoregate.sources.stages import staged

#: Ranges of a large group, rows drawn of one for its splitters, and rows up to which a group isn't large and is one range.
RANGES, SAMPLE, SMALL = 64, 2048, 65_536
_RANGE, _CUTS, _COUNT, _BEFORE, _PLACE, _ROW = "__sg_range", "__sg_cuts", "__sg_count", "__sg_before", "__sg_place", "__sg_row"


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on keys in which null equals null; the result has the left keys and the other columns of both."""
    renamed = right.select(*(F.col(k).alias(f"__sg_key_{k}") if k in keys else F.col(k) for k in right.columns))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__sg_key_{k}"))
    out = left.join(renamed, same, how)
    if how in ("full", "outer", "full_outer"):  # a row of the right side alone has no left keys
        right_only = F.col(_PLACE).isNull()
        left = left.withColumn(_PLACE, F.lit(True))
        out = left.join(renamed, same, how).withColumns({k: F.when(right_only, F.col(f"__sg_key_{k}")).otherwise(F.col(k)) for k in keys}).drop(_PLACE)
    return out.drop(*(f"__sg_key_{k}" for k in keys))


def held(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns written once with a number for each row, for at_ranks and others to read."""
    return staged(df.select(*dict.fromkeys(columns), F.monotonically_increasing_id().alias(_ROW)))


def ranged(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """df with the column ``__sg_range``: where among its group's splitters a row lies in the order of the columns named. Rows with a
    null in the first of them are in range -1. df is read three times: it should be a written table."""
    key = F.struct(*order)
    known = df.where(F.col(order[0]).isNotNull())
    large = known.groupBy(*groups).agg(F.count(F.lit(1)).alias(_COUNT)).where(F.col(_COUNT) > SMALL)
    if large.isEmpty():
        return df.withColumn(_RANGE, F.when(F.col(order[0]).isNull(), -1).otherwise(0))
    drawn = F.pmod(F.xxhash64(F.lit("splitters"), *order), F.lit(1 << 40)) / float(1 << 40) < SAMPLE / F.col(_COUNT)
    sample = null_safe_join(known, F.broadcast(large), groups).where(drawn)
    found = sample.groupBy(*groups).agg(F.sort_array(F.collect_list(key)).alias(_CUTS))
    every = F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda i: F.get(_CUTS, F.floor(i * F.size(_CUTS) / RANGES).cast("int")))
    cuts = found.select(*groups, F.array_distinct(every).alias(_CUTS))
    below = F.size(F.filter(F.col(_CUTS), lambda c: c < key))
    return null_safe_join(df, F.broadcast(cuts), groups, "left").withColumn(
        _RANGE, F.when(F.col(order[0]).isNull(), -1).when(F.col(_CUTS).isNull(), 0).otherwise(below)
    ).drop(_CUTS)


def running(df: DataFrame, groups: list[str], value: str, sums: dict[str, Column], descending: bool = False, ties: list[str] | None = None) -> DataFrame:
    """df with running sums in the order of value (then of ties), equal rows included: {new column: summed column}. Equal rows count as
    one place, so those of a range come together; a table with many should be grouped first."""
    cut = ranged(staged(df), groups, [value] if descending else [value, *(ties or [])])
    totals = cut.groupBy(*groups, _RANGE).agg(*(F.sum(c).alias(f"__sg_t_{n}") for n, c in sums.items()))
    order = F.col(_RANGE).desc() if descending else F.col(_RANGE)
    above = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, _RANGE, *(F.coalesce(F.sum(f"__sg_t_{n}").over(above), F.lit(0)).alias(f"__sg_o_{n}") for n in sums))
    by = [F.col(value).desc() if descending else F.col(value), *map(F.col, ties or [])]
    inside = Window.partitionBy(*groups, _RANGE).orderBy(*by)
    out = null_safe_join(cut, F.broadcast(offsets), [*groups, _RANGE])
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"__sg_o_{n}") + F.sum(c).over(inside))
    return out.drop(_RANGE, *(f"__sg_o_{n}" for n in sums))


def at_ranks(df: DataFrame, groups: list[str], value: str, ranks: dict[str, Column], ties: list[str] | None = None, kept: list[str] | None = None) -> DataFrame:
    """The rows of each group at given 1-based ranks in the order (value, ties): groups, rank_name, ``__sg_count`` (rows of the
    group), value and the kept columns. ranks: name -> rank as a column over ``__sg_count``. Null values have no rank. Only
    ranges that hold a rank are ordered. df is written first, unless it comes from ``held``."""
    ties, kept = ties or [], kept or []
    if _ROW not in df.columns:
        df = held(df, [*groups, value, *ties, *kept])
    cut = ranged(df.where(F.col(value).isNotNull()), groups, [value, *ties, _ROW])
    sizes = cut.groupBy(*groups, _RANGE).agg(F.count(F.lit(1)).alias(_PLACE))
    upto, whole = F.sum(_PLACE).over(Window.partitionBy(*groups).orderBy(_RANGE)), F.sum(_PLACE).over(Window.partitionBy(*groups))
    placed = sizes.withColumn(_BEFORE, upto - F.col(_PLACE)).withColumn(_COUNT, whole)
    named = F.array(*(F.struct(F.lit(n).alias("rank_name"), r.cast("long").alias("__sg_rank")) for n, r in ranks.items()))
    wanted = placed.select(*groups, _RANGE, _BEFORE, _COUNT, _PLACE, F.inline(named)).where(
        f"{_BEFORE} < __sg_rank and __sg_rank <= {_BEFORE} + {_PLACE}"
    ).drop(_PLACE)
    wanted = wanted.groupBy(*groups, _RANGE, _BEFORE, _COUNT).agg(F.collect_list(F.struct("rank_name", "__sg_rank")).alias("__sg_asked"))
    inside = Window.partitionBy(*groups, _RANGE).orderBy(value, *ties, _ROW)
    ranked = null_safe_join(cut, F.broadcast(wanted), [*groups, _RANGE]).withColumn("__sg_at", F.col(_BEFORE) + F.row_number().over(inside))
    rows = ranked.select(*groups, value, *kept, _COUNT, "__sg_at", F.inline("__sg_asked")).where("__sg_at = __sg_rank")
    return rows.select(*groups, "rank_name", F.col("__sg_rank").alias("rank"), _COUNT, value, *kept)


def median_and_more(df: DataFrame, groups: list[str], value: str, quantiles: dict[str, float] | None = None, median: str = "median") -> DataFrame:
    """groups, the exact median and nearest-rank quantiles of a value, {name: quantile}; null values are left out."""
    n = F.col(_COUNT)
    ranks = {"__sg_low": F.floor((n + 1) / 2), "__sg_high": F.floor(n / 2) + 1} | {
        name: F.ceil(F.lit(float(q)) * n.cast("double")) for name, q in (quantiles or {}).items()
    }
    found = at_ranks(df, groups, value, ranks)
    pick = lambda name: F.max(F.when(F.col("rank_name") == name, F.col(value)))
    middle = (pick("__sg_low").cast("double") + pick("__sg_high").cast("double")) / 2
    return found.groupBy(*groups).agg(middle.alias(median), *(pick(name).alias(name) for name in quantiles or {}))


def numbered(df: DataFrame, groups: list[str], digest: str, ties: list[str], name: str = "selection_rank", digits: int = 3) -> DataFrame:
    """df with 1-based ranks in the order of an evenly spread hex digest, then of ties; ranges are the first hex digits."""
    cut = df.withColumn(_RANGE, F.substring(digest, 1, digits))
    return _numbered(cut, groups, [digest, *ties], name)


def ordinals(df: DataFrame, groups: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """df with 1-based ranks of each group in the order of columns of any kind: Spark's sampled range partitions, written once,
    are the ranges."""
    cut = staged(df.repartitionByRange(*groups, *order).withColumn(_RANGE, F.spark_partition_id()))
    return _numbered(cut, groups, order, name)


def _numbered(cut: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    sizes = cut.groupBy(*groups, _RANGE).agg(F.count(F.lit(1)).alias(_COUNT))
    above = Window.partitionBy(*groups).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, _RANGE, F.coalesce(F.sum(_COUNT).over(above), F.lit(0)).alias(_BEFORE))
    inside = Window.partitionBy(*groups, _RANGE).orderBy(*order)
    return null_safe_join(cut, offsets, [*groups, _RANGE]).withColumn(name, F.col(_BEFORE) + F.row_number().over(inside)).drop(_RANGE, _BEFORE)

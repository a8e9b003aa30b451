"""Scoring of vectors: nearest neighbour in a bank, position z-scores, median templates, tiles.

Defined cases: no item is lost. A vector that is null, too short or doesn't divide into patches gives one row at position -1
with a null patch (a grid of the wrong size one tile at -1, -1), whose distance and so the item's score are null: with_failures
makes a failed row of it. A position without fitted state and an empty bank give null distances too. Repeated items share one
score; empty tables give empty results; helper columns begin with ``__sg_``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from scoregate.functions import scalars as S
from scoregate.operators.contracts import require_columns
from scoregate.operators.pivots import nearest_in_bank
from scoregate.operators.prefix import median_and_more, null_safe_join
from scoregate.sources.stages import staged

#: Bank rows that are compared as a whole, and query rows at a time; larger banks are searched by pivots.
BROADCAST_ROWS, BLOCK = 4096, 2048


def patches(items: DataFrame, item: str, vector: str, size: int) -> DataFrame:
    """Consecutive pieces of each vector: item, position (from 0), patch."""
    kind = items.schema[vector].dataType.simpleString()
    at = F.when(
        (F.size(vector) >= size) & (F.size(vector) % size == 0), F.sequence(F.lit(0), (F.size(vector) / size).cast("int") - 1)
    ).otherwise(F.array(F.lit(-1)))
    placed = items.select(item, F.col(vector).alias("__sg_v"), F.explode(at).alias("position"))
    return placed.select(item, "position", F.when(F.col("position") >= 0, F.slice("__sg_v", F.col("position") * size + 1, size)).cast(kind).alias("patch"))


def tiles(items: DataFrame, item: str, vector: str, height: int, width: int, tile: tuple[int, int], stride: tuple[int, int]) -> DataFrame:
    """Row-major tiles of vectors read as height x width grids: item, tile_row, tile_col, tile (flat)."""
    rows, cols = (F.sequence(F.lit(0), F.lit(n - t), F.lit(s)) for n, t, s in zip((height, width), tile, stride, strict=True))
    held = items.select(item, F.col(vector).alias("__sg_v"), F.coalesce(F.size(vector) == height * width, F.lit(False)).alias("__sg_ok"))
    at = held.where("__sg_ok").select(
        item, "__sg_v", F.posexplode(rows).alias("tile_row", "__sg_r")
    ).select("*", F.posexplode(cols).alias("tile_col", "__sg_c"))
    cut = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(tile[0] - 1)),
            lambda k: F.slice("__sg_v", (F.col("__sg_r") + k) * width + F.col("__sg_c") + 1, tile[1])
        )
    )
    wrong = held.where("not __sg_ok").select(
        item,
        F.lit(-1).alias("tile_row"),
        F.lit(-1).alias("tile_col"),
        F.lit(None).cast(items.schema[vector].dataType).alias("tile")
    )
    return at.select(item, "tile_row", "tile_col", cut.alias("tile")).unionByName(wrong)


def bank(patched: DataFrame) -> DataFrame:
    """Unit vectors of reference patches; zero and null patches are left out."""
    unit = patched.withColumn("patch", S.unit(F.col("patch")))
    return unit.where(F.exists("patch", lambda x: x != 0)).select("patch")


def _rows(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the vectors that are there and hold no null, as a matrix; which rows these are)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    holes = np.zeros(len(sizes), bool)
    if flat.null_count:
        holes[np.repeat(np.arange(len(sizes)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    there = np.flatnonzero((sizes > 0) & ~holes)
    width = int(sizes[there[0]]) if len(there) else 0
    kept = column.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False)
    return kept.reshape(len(there), width), there


def _nearest(queries: np.ndarray, reference: np.ndarray | None) -> np.ndarray:
    out = np.full(len(queries), np.nan)
    if reference is not None and len(reference):
        unit = queries / np.maximum(np.sqrt((queries * queries).sum(1)), 1e-12)[:, None]
        for a in range(0, len(unit), BLOCK):
            out[a : a + BLOCK] = np.clip(1 - (unit[a : a + BLOCK] @ reference.T).max(1), 0, 2)
    return out


def nearest_distances(queries: DataFrame, item: str, reference: DataFrame, protected: tuple[str, ...] = ("label",)) -> DataFrame:
    """The cosine distance of each query patch (item, position, patch) to the nearest of the reference patches. The bank is written
    once and counted: a small one is broadcast and compared as a whole; of a larger one, pieces are broadcast one after another and
    most of it is never compared (pivots.nearest_in_bank). Queries aren't shuffled."""
    require_columns(queries, [item, "position", "patch"], protected)
    schema = f"{item} {queries.schema[item].dataType.simpleString()}, position int, distance double"
    reference = staged(reference.select(F.col("patch").cast("array<double>").alias("patch")))
    asked = queries.select(item, F.col("position").cast("int").alias("position"), F.col("patch").cast("array<double>").alias("patch"))
    count = reference.count()
    if count <= BROADCAST_ROWS:
        head = reference.limit(BROADCAST_ROWS).toArrow()
        shared = queries.sparkSession.sparkContext.broadcast(_rows(head["patch"])[0] if head.num_rows else None)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, there = _rows(batch.column(2))
                d = np.full(batch.num_rows, np.nan)
                d[there] = _nearest(x, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, mask=np.isnan(d))], names=[item, "position", "distance"])

        return asked.mapInArrow(nearest, schema)
    return nearest_in_bank(asked, item, reference).select(item, "position", "distance")


def top_patches(scored: DataFrame, item: str, value: str, k: int) -> DataFrame:
    """The k largest patches of each item, ties by position."""
    order = Window.partitionBy(item).orderBy(F.desc(value), "position")
    return scored.withColumn("patch_rank", F.row_number().over(order)).where(F.col("patch_rank") <= k).withColumn(
        "patch_rank", F.col("patch_rank").cast("long")
    )


def item_scores(distances: DataFrame, item: str, value: str, fraction: float, rounding: str) -> DataFrame:
    """Each item's mean over the top fraction of its patches; null if one of them has no value."""
    held = distances.groupBy(item).agg(F.collect_list(value).alias("__sg_values"), F.count_if(F.col(value).isNull()).alias("__sg_missing"))
    return held.select(item, F.when(F.col("__sg_missing") == 0, S.top_fraction_mean(F.col("__sg_values"), fraction, rounding)).alias("score"))


def position_scalers(reference: DataFrame) -> DataFrame:
    """Mean and population deviation of each position and dimension of (position, patch); a deviation of 0 scales by 1."""
    flat = reference.select("position", F.posexplode("patch").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    out = flat.groupBy("position", "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    return out.withColumn("scale", F.when(F.col("deviation") == 0, 1.0).otherwise(F.col("deviation")))


def position_zscores(patched: DataFrame, item: str, scalers: DataFrame) -> DataFrame:
    """Mean squared z of each patch against its position's scalers: item, position, distance. A stand-in for a one-class model of
    each position, not equal to one."""
    state = scalers.groupBy("position").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "scale"))).alias("__sg_s"))
    z = F.zip_with(F.col("patch").cast("array<double>"), F.col("__sg_s"), lambda x, s: F.pow((x - s["mean"]) / s["scale"], 2))
    return patched.join(F.broadcast(state), "position", "left").select(
        item, "position", (F.aggregate(z, F.lit(0.0), lambda a, v: a + v) / F.size("patch")).alias("distance")
    )


def median_template(reference: DataFrame, vector: str, support: float = 0.75) -> DataFrame:
    """Median and support of each dimension over the reference vectors, nulls left out: dim, median, supported, support_share."""
    flat = reference.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    out = flat.groupBy("dim").agg(F.bool_and(F.col("x").isNotNull()).alias("supported"), F.avg(F.col("x").isNotNull().cast("double")).alias("support_share"))
    out = null_safe_join(out, median_and_more(flat, ["dim"], "x"), ["dim"], "left")
    return out.withColumn("template_ok", F.col("support_share") >= support)


def template_residuals(items: DataFrame, item: str, vector: str, template: DataFrame, fraction: float = 0.01, least_support: float = 0.95) -> DataFrame:
    """The mean of the largest share of absolute residuals from the median template, and a failure where too little is supported."""
    state = template.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("dim", "median", "supported"))),
            lambda s: F.struct(s["median"].alias("m"), s["supported"].alias("ok"))
        ).alias("__sg_t")
    )
    pairs = F.zip_with(F.col(vector).cast("array<double>"), F.col("__sg_t"), lambda x, t: F.when(t["ok"] & x.isNotNull(), F.abs(x - t["m"])))
    joined = items.join(F.broadcast(state), F.lit(True)).withColumn("__sg_r", F.array_compact(pairs))
    share = F.when(F.col(vector).isNotNull(), F.size("__sg_r") / F.size(F.filter("__sg_t", lambda t: t["ok"])))
    ok = F.coalesce(share >= least_support, F.lit(False))
    return joined.select(
        item,
        share.alias("support_ratio"),
        F.when(ok, "ok").otherwise("failed").alias("score_status"),
        F.when(~ok, "SUPPORT_TOO_SMALL").alias("failure_code"),
        F.when(ok, S.top_fraction_mean(F.col("__sg_r"), fraction, "ceil")).alias("score"),
    )

"""Selection of reference and calibration rows, opaque identifiers, and the split of items from labels.

Defined cases: rows with a null group or path stay; a null group is a group of its own, null paths come first in the order.
Repeated rows get ranks of their own; empty tables give empty results; helper columns begin with ``__sg_``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scoregate.functions import scalars as S
from scoregate.operators.prefix import numbered
from scoregate.sources.stages import staged


def seeded_partitions(rows: DataFrame, namespace: str, seed: int, references: int, group: str, path: str) -> DataFrame:
    """Rows ranked in each group by (SHA-256 of namespace:seed:path, path): the first `references` are the reference
    partition and the rest calibration, ranks going on. Adds record_id, selection_sha256, selection_rank, partition."""
    hashed = rows.withColumn(
        "selection_sha256", S.selection_digest(namespace, seed, F.col(path))
    ).withColumn("record_id", S.record_id(F.col(group), F.col(path)))
    ranked = numbered(hashed, [group], "selection_sha256", [path])
    return ranked.withColumn("partition", F.when(F.col("selection_rank") <= references, "reference").otherwise("calibration"))


def first_by_digest(rows: DataFrame, namespace: str, seed: int, key: str, k: int) -> DataFrame:
    """The k rows that come first by (digest, key)."""
    return rows.withColumn("selection_sha256", S.selection_digest(namespace, seed, F.col(key))).orderBy("selection_sha256", key).limit(k)


def opaque_order(rows: DataFrame, key: bytes, path: str) -> DataFrame:
    """Rows with an asset_id whose order only the holder of the key (32 bytes at least) can tell: HMAC order, from 0."""
    if len(key) < 32:
        raise ValueError("an ordering key has at least 32 bytes")
    hashed = rows.withColumn("__sg_one", F.lit(0)).withColumn("__sg_hmac", S.hmac_sha256(key, F.col(path).cast("string")))
    ranked = numbered(hashed, ["__sg_one"], "__sg_hmac", [path], "__sg_rank")
    return ranked.withColumn("asset_id", S.asset_id(F.col("__sg_rank") - 1)).drop("__sg_one", "__sg_rank", "__sg_hmac")


def split_labels(rows: DataFrame, key: bytes, path: str, label: str, item_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(label-free items, sealed mapping of asset_id to path and label): they share asset_id alone. The order is worked out and
    written once, so that both sides see the same ids."""
    forbidden = {label, path} & set(item_columns)
    if forbidden:
        raise ValueError(f"items would reveal {sorted(forbidden)}")
    opaque = staged(opaque_order(rows, key, path))
    return opaque.select("asset_id", *item_columns), opaque.select("asset_id", F.col(path).alias("source_path"), F.col(label).alias("class_label"))


def write_split(rows: DataFrame, key: bytes, path: str, label: str, item_columns: list[str], items_root: str, sealed_root: str) -> None:
    """split_labels written to two roots, neither of which lies in the other; an existing root is never overwritten."""
    own, sealed = (f"{r.rstrip('/')}/" for r in (items_root, sealed_root))
    if own.startswith(sealed) or sealed.startswith(own):
        raise ValueError("the sealed root must lie outside the items' root, and the other way round")
    items, mapping = split_labels(rows, key, path, label, item_columns)
    mapping.orderBy("asset_id").write.mode("errorifexists").parquet(sealed_root)
    items.orderBy("asset_id").write.mode("errorifexists").parquet(items_root)


def anchors(rows: DataFrame, group: str, path: str, name: str = "anchor") -> DataFrame:
    """The first path of each group."""
    return rows.groupBy(group).agg(F.min(path).alias(name))


def overlapping(rows: DataFrame, key: str, partition: str) -> DataFrame:
    """Keys that stand in more than one partition, or twice in one."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(partition).alias("partition_count")).where("row_count > 1")

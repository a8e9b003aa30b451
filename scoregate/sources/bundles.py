"""Bundles of tables, fitted states and array stores, each with digests that are checked before use."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, functions as F

from scoregate.operators.inventory import ordered_digest
from scoregate.operators.prefix import null_safe_join


def content_digest(df: DataFrame, groups: list[str]) -> DataFrame:
    """A digest and row count of each group's rows, whatever their order."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    keyed = df.select(*groups, row.alias("__sg_row"))
    return ordered_digest(keyed, groups, "__sg_row", F.col("__sg_row"))


def write_bundle(tables: dict[str, DataFrame], path: str, staging: bool = True) -> None:
    """Each table by method, then the manifest (type, method, path, digest, rows), all to a staging folder beside path that gets its
    name only when everything is there: the bundle is whole or absent. An existing path is never overwritten. Where a folder can't
    be renamed in one step, publish is the way; it writes without staging."""
    spark = next(iter(tables.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, held = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}" if staging else path))
    system = target.getFileSystem(conf)
    if system.exists(target):
        raise FileExistsError(path)
    manifests = []
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").partitionBy("method").parquet(f"{held.toString()}/{name}")
            stored = spark.read.schema(df.schema).parquet(f"{held.toString()}/{name}")
            relative = F.concat(F.lit(f"{name}/method="), F.coalesce(F.col("method").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
            manifests.append(
                content_digest(stored, ["method"]).select(
                    F.lit(name).alias("artifact_type"),
                    "method",
                    relative.alias("relative_path"),
                    F.col("digest").alias("sha256"),
                    F.col("line_count").alias("record_count")
                )
            )
        reduce(DataFrame.unionByName, manifests).orderBy("relative_path").write.mode("errorifexists").parquet(f"{held.toString()}/_bundle_manifest.parquet")
        if staging and not system.rename(held, target):
            raise FileExistsError(path)
    except BaseException:
        system.delete(held, True)
        raise


def publish(tables: dict[str, DataFrame], path: str, replaces: int | None = None) -> int:
    """A version of a bundle where nothing can be renamed as one step: its tables and manifest are written to an attempt's own folder, and
    only then one small commit record, whose creation fails if another writer's is there. Returns the version. replaces: the version
    that this one follows, None for the first; readers see the old version or the new one (committed), never a mixture, and what an
    attempt left behind that was never committed is seen by none. Where a store shows files before they are closed, a writer may be lost
    within its record: readers pass over that, and it has to be deleted before the next version."""
    spark = next(iter(tables.values())).sparkSession
    version, attempt = (replaces or 0) + 1, uuid.uuid4().hex
    if _committed(spark, path).get("version") != replaces:
        raise FileExistsError(f"{path}: version {_committed(spark, path).get('version')} is there, not {replaces}")
    write_bundle(tables, f"{path.rstrip('/')}/attempts/{attempt}", staging=False)
    body = json.dumps({"version": version, "attempt": attempt, "manifest": state_digest(read_manifest(spark, f"{path}/attempts/{attempt}"))}, sort_keys=True)
    _create(spark, f"{path.rstrip('/')}/commits/{version:09d}.json", json.dumps({"body": body, "sha256": sha256(body.encode()).hexdigest()}).encode())
    return version


def _create(spark: SparkSession, path: str, content: bytes) -> None:
    """A new file, by the one step that every store makes whole: to create what isn't there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    except Exception as problem:
        raise FileExistsError(path) from problem
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def _committed(spark: SparkSession, path: str) -> dict:
    """The last commit record that is whole; an empty one if there is none. A torn record is passed over."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/commits")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return {}
    names = sorted((s.getPath().toString() for s in system.listStatus(folder) if s.getPath().getName().endswith(".json")), reverse=True)
    for name in names:
        text = "".join(r["value"] for r in spark.read.text(name, wholetext=True).limit(1).collect())
        try:
            record = json.loads(text)
            if sha256(record["body"].encode()).hexdigest() == record["sha256"]:
                return json.loads(record["body"])
        except (ValueError, KeyError, TypeError):
            continue
    return {}


def open_bundle(spark: SparkSession, path: str) -> tuple[int, str]:
    """The version that is committed and the folder of its tables, whose manifest is as recorded."""
    found = _committed(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} has no committed version")
    folder = f"{path.rstrip('/')}/attempts/{found['attempt']}"
    if state_digest(read_manifest(spark, folder)) != found["manifest"]:
        raise ValueError(f"{folder} isn't what its commit record says")
    return found["version"], folder


def bundle_violations(spark: SparkSession, path: str, schemas: dict) -> DataFrame:
    """Entries of a bundle's manifest whose stored rows have another digest or number, with the table's schema by name."""
    found = [
        content_digest(spark.read.schema(schema).parquet(f"{path}/{name}"), ["method"]).select(
            F.lit(name).alias("artifact_type"),
            "method",
            F.col("digest").alias("__sg_digest"),
            F.col("line_count").alias("__sg_rows")
        )
        for name, schema in schemas.items()
    ]
    both = null_safe_join(read_manifest(spark, path), reduce(DataFrame.unionByName, found), ["artifact_type", "method"], "full_outer")
    return both.where(
        ~F.col("sha256").eqNullSafe(F.col("__sg_digest")) | ~F.col("record_count").eqNullSafe(F.col("__sg_rows"))
    ).select("artifact_type", "method", "relative_path")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_bundle_manifest.parquet")


def save_state(df: DataFrame, path: str) -> str:
    """Write a state table; its digest."""
    df.write.mode("errorifexists").parquet(path)
    return state_digest(df.sparkSession.read.parquet(path))


def state_digest(df: DataFrame) -> str:
    row = content_digest(df, []).first()
    return row["digest"] or ""


def load_state(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """A state table whose digest is as recorded."""
    df = spark.read.parquet(path)
    if (found := state_digest(df)) != digest:
        raise ValueError(f"state {path} has digest {found}, not {digest}")
    return df


def write_arrays(df: DataFrame, item: str, values: str, path: str) -> None:
    """Arrays with the SHA-256 of their text form."""
    digest = F.sha2(F.concat_ws(",", F.col(values).cast("array<string>")), 256)
    df.select(F.col(item).alias("item"), F.col(values).alias("values"), digest.alias("sha256")).write.mode("errorifexists").parquet(path)


#: Bytes of a row group of an indexed store, and rows of a page, which are what a fetch reads.
GROUP_BYTES, PAGE_ROWS = 4 << 20, 1024


def write_indexed(df: DataFrame, item: str, values: str, path: str) -> None:
    """Arrays with their digest, in files whose ranges of items don't overlap, each sorted by item: the statistics of files, row groups and
    pages then say where an item is."""
    digest = F.sha2(F.concat_ws(",", F.col(values).cast("array<string>")), 256)
    out = df.select(F.col(item).alias("item"), F.col(values).alias("values"), digest.alias("sha256")).repartitionByRange("item").sortWithinPartitions("item")
    out.write.mode("errorifexists").option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


def fetch(spark: SparkSession, path: str, items: list) -> DataFrame:
    """The arrays of some items of an indexed store, with whether each has its digest still; the items are looked up by the filter that is
    pushed to the files, so that only row groups and pages that may hold one are read."""
    return read_arrays(spark, path).where(F.col("item").isin(*items))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Stored arrays with whether each still has its digest."""
    df = spark.read.parquet(path)
    return df.withColumn("verified", F.sha2(F.concat_ws(",", F.col("values").cast("array<string>")), 256).eqNullSafe(F.col("sha256")))

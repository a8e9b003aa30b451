"""Contract files: typed CSV and JSON lines with fixed columns, and byte identities."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scoregate.operators.contracts import contiguity
from scoregate.operators.inventory import evidence
from scoregate.sources import records
from scoregate.sources.stages import staged


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with exactly this header; empty cells are null, a malformed cell or another header fails the read. JSON cells are
    quoted with doubled quotes."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, escape='"', mode="FAILFAST")


def write_csv(df: DataFrame, path: str, keys: list[str]) -> None:
    """A CSV in key order with null as the empty cell; an existing path is never overwritten."""
    df.orderBy(*keys).write.mode("errorifexists").csv(path, header=True, nullValue="", escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, located: bool = False) -> DataFrame:
    """JSON lines; a line that can't be read fails the read. located: look first for lines that aren't objects, and name them."""
    if located and (broken := records.json_records(spark, path).where(F.col("reason").isNotNull()).orderBy("file", "line").limit(5).collect()):
        raise ValueError("; ".join(f"{r['file'].rsplit('/', 1)[-1]}:{r['line']} {r['reason']}" for r in broken))
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object on each line with sorted keys and nulls written out; an existing path is never overwritten."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


SPLIT = "object string, split string, label string, image string, mask string"


def read_split(spark: SparkSession, path: str, category: str, sha256: str | None = None) -> DataFrame:
    """Rows of a split table (object, split, label, image, mask) of one category. With a digest the one file at the path must have it;
    then each row has its source_row too, from 2, the header being row 1. A record that can't be read is an error, and so are a path
    of the category that lies outside its folder or comes twice (records.split_scan_violations lists them all)."""
    if sha256 is not None:
        found = [r["found"] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("found")).limit(2).collect()]
        if found != [sha256]:
            raise ValueError(f"{path} has the digest {found}, not {sha256}")
    rows = staged(records.csv_records(spark, path, SPLIT))
    wrong = ("header", "malformed", "quote_not_closed", "unsafe_path", "outside_category", "repeated_path")
    broken = records.split_scan_violations(rows, category).where(F.col("reason").isin(*wrong)).limit(5).collect()
    if broken:
        raise ValueError(f"{path}: " + ", ".join(f"{r['reason']} at line {r['line']}" for r in broken))
    own = records.split_rows(rows, category)
    return own.select(*(["source_row"] if sha256 is not None else []), *(c.split(" ")[0] for c in SPLIT.split(", ")))


def read_exactly(spark: SparkSession, path: str, schema: T.StructType, expected: dict, group: str = "method") -> DataFrame:
    """A contract CSV that must hold exactly so many rows of each group ({group: rows}), no more groups and no fewer."""
    rows = read_csv(spark, path, schema)
    found = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).limit(len(expected) + 1).collect()}
    if found != expected:
        raise ValueError(f"{path} holds {found} rows, not {expected}")
    return rows


def read_ranked(spark: SparkSession, path: str, schema: T.StructType, groups: list[str], rank: str) -> DataFrame:
    """A contract CSV whose ranks must run from 1 without gap or repeat in each group."""
    rows = read_csv(spark, path, schema)
    broken = contiguity(rows, groups, rank, 1).where("not contiguous").limit(5).collect()
    if broken:
        raise ValueError(f"{path} has ranks that don't run from 1 in {[tuple(r[g] for g in groups) for r in broken]}")
    return rows


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document with sorted keys, in one file below path; an existing path is never overwritten. Not finite numbers are
    refused."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} doesn't hold one document")
    return json.loads(rows[0]["value"])


def write_bytes(assets: DataFrame, content: str, path: str, suffix: str) -> None:
    """Each row's text as a line of text files below path, grouped by the suffix column: what read_bytes then reads as bytes."""
    assets.select(F.col(suffix).alias("part"), F.col(content).alias("value")).repartition("part").write.mode("errorifexists").partitionBy("part").text(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path: asset (its path there) and content. The reader passes over files without any byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace(F.col("path"), F.lit(r"^.*?" + path.rstrip("/").rsplit("/", 1)[-1] + "/"), F.lit("")).alias("asset"), "content")


def byte_manifest(assets: DataFrame, asset: str, content: str) -> DataFrame:
    """Byte count and SHA-256 of each asset."""
    return assets.select(asset, F.octet_length(content).cast("long").alias("byte_count"), F.sha2(content, 256).alias("sha256"))


def verify_bytes(assets: DataFrame, manifest: DataFrame, asset: str, content: str) -> DataFrame:
    """The manifest with the verification of each of its assets: verified, absent or changed."""
    return evidence(manifest, byte_manifest(assets, asset, content), asset, ["byte_count", "sha256"])

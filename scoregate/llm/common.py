"""Shared pieces of the llm operators: scratch tables, words, connected components."""

from __future__ import annotations

import ctypes
import gc
import json
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scoregate.sources.stages import shared_dir

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this library to the Python workers of the session's executors, which need not have it installed, once for each
    application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="scoregate-")) / f"{package.name}_{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped[context.applicationId] = str(target)


class Scratch:
    """Tables written to the shared folder, so that lineage is cut by files that outlive any executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/scoregate-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete scratch tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            for file in df.inputFiles()[:1]:
                folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
                if f"/{self.base.rsplit('/', 1)[1]}/" in folder.toString():
                    folder.getFileSystem(conf).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, UPPER.lower())


def words_of(column):
    """The words of a text as an array; empty for null, empty or blank texts."""
    parts = F.split(F.coalesce(column, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


def word_count(column):
    """How many words a text has, from the number of separators removed, without building an array."""
    text = F.coalesce(column, F.lit(""))
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


#: Rows of an Arrow batch, and bytes of its text, worked on at a time, which bounds what a worker holds beside the batch.
SLICE, SLICE_BYTES = 1024, 4 << 20


#: What a Python worker keeps from task to task, all of one owner.
_kept: dict = {}


def kept_by(owner: str) -> dict:
    """The worker's store for an owner; what another one left there is dropped."""
    if _kept.get("owner") != owner:
        _kept.clear()
        _kept.update(owner=owner, values={})
    return _kept["values"]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, owner: str = "", column: str | int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows and, where a string column is named, of about SLICE_BYTES of its text; a longer
    text is a piece of its own. When they end, the worker gives back the memory that it no longer uses, as it lives on beside the
    next tasks."""
    kept_by(owner)
    try:
        for batch in batches:
            if column is None:
                ends = None
            else:
                ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = at + rows
                if ends is not None:
                    before = ends[at - 1] if at else 0
                    end = min(end, max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
                yield batch.slice(at, end - at)
                at = end
    finally:
        _give_back()


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_batches(batches: Iterator, column: str = "text", owner: str = "") -> Iterator:
    """(record batch, list of texts with null as None) of each piece of the batches."""
    for batch in slices(batches, owner=owner, column=column):
        yield batch, batch.column(batch.schema.get_field_index(column)).to_pylist()


#: Edges that a file of a scratch table holds, about.
EDGES_A_FILE = 1_000_000


def _are_stars(e: DataFrame) -> bool:
    """Whether each u has one edge and is no v: then every v is the smallest node of its component."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up = 1 and root = 1").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of an undirected graph given as (src, dst) longs: one (node, root) row for each node of an edge,
    root being the smallest node reachable.

    Alternating large-star and small-star steps until all that is left are stars, which is tested exactly: every step is a
    grouped minimum and an equi-join; the edges never come to the driver. Each round is a written table, in as many files
    as its edges need. Null ends and self loops are dropped; an empty graph gives an empty table."""
    e = (
        edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    e = scratch.table(e, "edges")
    while not _are_stars(e):
        files = 1 + e.count() // EDGES_A_FILE
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        following = scratch.table(small.coalesce(files), "edges")
        scratch.drop(e)
        e = following
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


#: Bits of a sieve: 256 KB, whatever it holds.
SIEVE_BITS = 1 << 21


def sieve(places: DataFrame) -> Callable[[Column], Column]:
    """A bit set of the column place (longs), as a function that says of a long whether it may be among them: it is, or shares its
    bit with one that is. It keeps rows out of a shuffle that decides the rest, in expressions alone."""
    at = F.pmod("place", F.lit(SIEVE_BITS))
    words = places.select(F.shiftright(at, 6).alias("word"), F.lit(1).cast("long").alias("one"), (at % 64).cast("int").alias("bit"))
    held = [0] * (SIEVE_BITS >> 6)
    for row in words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).collect():
        held[row["word"]] = row["bits"]
    table = F.from_json(F.lit(json.dumps(held)), "array<bigint>")

    def maybe(place: Column) -> Column:
        own = F.pmod(place, F.lit(SIEVE_BITS))
        bits = F.get(table, F.shiftright(own, 6).cast("int"))
        return F.call_function("shiftrightunsigned", bits, (own % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    return maybe


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of text taken at a time by the vectorised readers; a longer text is taken whole.
TEXT_CHUNK = 1 << 20
#: Bytes of a word that the tabulation hash covers; longer words are hashed one by one.
_COVERED = 64
_RANDOM = mix64(np.arange(1, _COVERED * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Cuts a string column into runs of rows of about TEXT_CHUNK bytes: (first row, last row + 1, the bytes of the
    texts without any space between, where each text starts and the last ends). Null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + TEXT_CHUNK, "right")) - 1)
        yield row, end, data[at[row] : at[end]].to_pybytes() if data is not None else b"", at[row : end + 1] - at[row]
        row = end


def word_hashes(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of the texts raw[at[i]:at[i + 1]], and where each text's words start and the last end.
    Simple tabulation over the bytes: two different words agree with a chance of 2**-64."""
    data = np.frombuffer(raw, np.uint8)
    inside = (data != 32) & (data - np.uint8(9) > 4)  # neither a space nor 9 to 13
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    where = np.flatnonzero(inside)
    first = np.flatnonzero(begins.take(where))
    lengths = np.diff(np.append(first, len(where)))
    at_random = where - np.repeat(starts, lengths)
    at_random &= _COVERED - 1
    at_random <<= 8
    at_random += data.take(where)
    h = np.add.reduceat(_RANDOM.take(at_random), first)
    for w in np.flatnonzero(lengths > _COVERED):
        h[w] = xxhash.xxh3_64_intdigest(raw[starts[w] : starts[w] + lengths[w]])
    return h, bounds


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` values."""
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        acc = (acc ^ h[j : len(h) - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return mix64(acc)

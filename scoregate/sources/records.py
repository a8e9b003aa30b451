"""Numbered records of large text files, in as many tasks as the files have splits, with broken records as rows.

A line's number is its place in its split plus the lines of the splits before, and a CSV record that runs over lines is known by
the parity of the quotes before it: each split counts its lines, its quotes and the records that begin in it, once for an even and
once for an odd number of quotes before. These few numbers are summed up along each file, and a second pass over the text puts
them together, so that no task reads a whole file and only records of several lines are gathered.

Defined cases: a byte order mark before the first line isn't part of it; a line may end in CR LF; an empty line outside quotes is
no record and has no number (it is a line, though); a quote counts wherever it stands; a record of more than MOST_LINES lines is
given as broken (quote_not_closed) and isn't put together; a file without a byte has no lines; files are numbered each on its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from scoregate.functions import scalars as S
from scoregate.operators.contracts import split_violations
from scoregate.sources.stages import staged

#: Lines of a record that are put together.
MOST_LINES = 10_000

_LINES = "file string, block long, at long, quotes long, before long, even long, odd long, text string"
_TOTALS = "file string, block long, lines long, quotes long, even long, odd long"


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The pieces of a batch that come from one split."""
    block = batch.column(1).to_numpy()
    name = batch.column(0).dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (name[1:] != name[:-1])))
    for a, b in zip(edges, np.append(edges[1:], len(block)), strict=True):
        yield (batch.column(0)[int(a)].as_py(), int(block[a])), batch.slice(int(a), int(b - a))


def _pass(totals: bool):
    """Lines with what their split holds up to them, or one row for each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, carried = None, np.zeros(4, np.int64)  # lines, quotes, records that begin after an even and an odd number of quotes

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([of[0]]), pa.array([of[1]], pa.int64()), *(pa.array([int(n)], pa.int64()) for n in carried)],
                names=["file", "block", "lines", "quotes", "even", "odd"]
            )

        for whole in batches:
            for key, batch in _blocks(whole):
                if key != of:
                    if totals and of is not None:
                        yield ended()
                    of, carried = key, np.zeros(4, np.int64)
                text = batch.column(2)
                quotes = pc.count_substring(text, '"').to_numpy().astype(np.int64)
                filled = ~pc.is_in(text, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
                before = carried[1] + np.cumsum(quotes) - quotes
                even, odd = (carried[k] + np.cumsum(filled & (before % 2 == k - 2)) for k in (2, 3))
                if not totals:
                    at = carried[0] + np.arange(1, len(quotes) + 1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), *map(pa.array, (at, quotes, before, even, odd)), text],
                        names=["file", "block", "at", "quotes", "before", "even", "odd", "text"]
                    )
                carried = np.array([carried[0] + len(quotes), before[-1] + quotes[-1], even[-1], odd[-1]])
        if totals and of is not None:
            yield ended()

    return run


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the files of a path: file, line (from 1), text; and of CSV: source_row (the record that it belongs to, null for none),
    begins (whether a record begins with it) and open (whether a quote is open at its end)."""
    source = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    held = staged(source.mapInArrow(_pass(True), _TOTALS))
    above = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    placed = held.withColumn("parity", upto("quotes") % 2).withColumn("lines_above", upto("lines"))
    placed = placed.withColumn("records_above", upto(F.when(F.col("parity") == 0, F.col("even")).otherwise(F.col("odd"))))
    lines = source.mapInArrow(_pass(False), _LINES).join(placed.select("file", "block", "parity", "lines_above", "records_above"), ["file", "block"])
    line = F.col("lines_above") + F.col("at")
    inside = (F.col("parity") + F.col("before")) % 2 == 1
    filled = ~F.col("text").isin("", "\r")
    record = F.col("records_above") + F.when(F.col("parity") == 0, F.col("even")).otherwise(F.col("odd"))
    return lines.select(
        "file", line.alias("line"), F.when(line == 1, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text")).alias("text"),
        F.when(inside | filled, record).alias("source_row"), (filled & ~inside).alias("begins"), (
            (F.col("parity") + F.col("before") + F.col("quotes")) % 2 == 1
        ).alias("open"),
    )


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """Every CSV record of the files of a path: file, source_row (from 1, a header being row 1), line (its first one), text, and reason: null,
    or quote_not_closed for a record that runs to the file's end or over more than MOST_LINES lines, whose text is its first line."""
    lines = numbered_lines(spark, path).where(F.col("source_row").isNotNull())
    whole = F.col("begins") & ~F.col("open")
    bare = lambda text: F.regexp_replace(text, "\r$", "")
    single = lines.where(whole).select("file", "source_row", "line", bare(F.col("text")).alias("text"), F.lit(None).cast("string").alias("reason"))
    several = staged(lines.where(~whole))
    sizes = several.groupBy("file", "source_row").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"), F.max_by("open", "line").alias("unclosed"))
    bad = (F.col("n") > MOST_LINES) | F.col("unclosed")
    parts = several.select(
        "file", "source_row", F.col("line").alias("__sg_line"), "text"
    ).join(sizes, ["file", "source_row"]).where(~bad | (F.col("__sg_line") == F.col("line")))
    ordered = F.array_sort(F.collect_list(F.struct("__sg_line", "text")))
    gathered = parts.groupBy("file", "source_row", "line", F.when(bad, "quote_not_closed").alias("reason")).agg(
        bare(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")).alias("text")
    )
    return single.unionByName(gathered)


def csv_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of contract CSV files: file, source_row, line, the columns of the schema, and reason: null, quote_not_closed, header
    (the first record isn't the header) or malformed (a cell of another type, too many or too few). Headers that are right aren't given."""
    fields = T.StructType.fromDDL(schema)
    header = ",".join(fields.names)
    first = F.col("source_row") == 1
    parsed = F.from_csv(
        "text",
        f"{schema}, __sg_corrupt string",
        {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__sg_corrupt", "lineSep": "\x01"}
    )
    rows = numbered_records(spark, path).where(~first | (F.col("text") != header)).withColumn("__sg_row", parsed)
    reason = S.any_code((F.col("reason").isNotNull(), "quote_not_closed"), (first, "header"), (F.col("__sg_row.__sg_corrupt").isNotNull(), "malformed"))
    return rows.select("file", "source_row", "line", *(F.when(reason.isNull(), F.col("__sg_row")[n]).alias(n) for n in fields.names), reason.alias("reason"))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """The lines of JSON files: file, line, text, and reason: null, not_json or not_an_object."""
    text = F.regexp_replace("text", "\r$", "")
    broken = F.try_parse_json(text).isNull()
    reason = S.any_code((broken, "not_json"), (~S.is_object(text), "not_an_object"))
    return numbered_lines(spark, path).select("file", "line", text.alias("text"), reason.alias("reason"))


def split_rows(rows: DataFrame, category: str) -> DataFrame:
    """Rows of csv_records over a split table that are of a category and whole."""
    return rows.where(F.col("reason").isNull() & (F.col("object") == category)).drop("reason")


def split_scan_violations(rows: DataFrame, category: str) -> DataFrame:
    """What is wrong with a split table for a category (file, source_row, line, reason): records that can't be read, whatever their category; and of
    its rows unsafe paths, paths outside the category's folder, paths met before, and splits and labels that break the rules.
    Without any row of the category one row says so."""
    own = staged(split_rows(rows, category))
    where = ["file", "source_row", "line"]
    outside = S.any_code((~S.safe_relative_path(F.col("image")), "unsafe_path"), (~F.startswith("image", F.lit(f"{category}/")), "outside_category"))
    again = F.row_number().over(Window.partitionBy("image").orderBy("file", "source_row")) > 1
    out = rows.where(F.col("reason").isNotNull()).select(*where, "reason")
    out = out.unionByName(own.select(*where, outside.alias("reason")).where("reason is not null"))
    out = out.unionByName(own.where(F.col("image").isNotNull()).select(*where, F.when(again, "repeated_path").alias("reason")).where("reason is not null"))
    out = out.unionByName(split_violations(own).select(*where, F.col("rule").alias("reason")))
    none: list[Column] = [
        F.lit(None).cast("string").alias("file"),
        F.lit(None).cast("long").alias("source_row"),
        F.lit(None).cast("long").alias("line"),
        F.lit("no_rows").alias("reason")
    ]
    return out.unionByName(own.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(*none))

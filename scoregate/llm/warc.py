"""A content-addressed web archive.

Method: the bytes of a payload are stored once, under their SHA-256, in the table ``payloads``; the exact header block of
every record is a row of the table ``headers``, with the key of its payload. Reading checks every payload against its key
and fails on a mismatch; joins of the two tables give the original WARC records back, byte for byte. The two tables are the
archive: Spark reads and splits them as it can't split WARC files; write_files makes such files of them.

Of equal payloads of at least ``revisit_from`` bytes the record with the largest page_id is a response and the others
revisit it; smaller ones are all responses. The copies of a payload are told apart by key and page_id alone: payload
bytes are dealt out at most once, by page_id, so that a payload that a third of the pages share is spread over all tasks,
and not at all where a bit set shows that a page is its payload's only or last one. Revisits have an empty block and never
meet the payload's bytes; the responses of a short payload, which may be many, are spread by SALTS.

Defined cases: a null html is an empty payload; a null url leaves out the target line, line breaks in a url are encoded;
rows repeated with the response's page_id are responses too; a null page_id counts below all others; further columns are
ignored; an empty table makes an empty archive."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scoregate.llm.common import sieve

REVISIT_FROM, SALTS = 1000, 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def _uri(page_id):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value):
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def _payload(html):
    return F.encode(F.coalesce(html.cast("string"), F.lit("")), "UTF-8")


def write_archive(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, date: str = DATE) -> None:
    """Archive the pages (page_id, url, html) under path, in the tables ``headers`` and ``payloads``."""
    content = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload(F.col("html")).alias("payload"))
    content = content.withColumn("payload_key", F.sha2("payload", 256))
    facts = content.select("page_id", "url", "payload_key", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest"))
    owners = facts.groupBy("payload_key").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("pages"))

    # The owner's row alone stays; of rows repeated with its page_id one is kept where the join has dealt them, without a shuffle.
    keys = ["payload_key", "_id", "_none"]
    placed = content.select("payload_key", F.coalesce("page_id", F.lit(0)).alias("_id"), F.col("page_id").isNull().alias("_none"), "payload")
    owned = owners.select("payload_key", F.coalesce("owner", F.lit(0)).alias("_id"), F.col("owner").isNull().alias("_none"), "pages")
    others = facts.join(owners.where("pages > 1"), "payload_key")
    others = others.select(F.xxhash64("payload_key", F.coalesce("page_id", F.lit(0)), F.col("page_id").isNull()).alias("place"))
    shared = sieve(others)(F.xxhash64(*keys))
    met = placed.where(shared).join(owned.hint("shuffle_merge"), keys, "left_semi").dropDuplicates(keys)
    stored = placed.where(~shared).unionByName(met)
    stored.select("payload_key", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")

    revisit = (F.col("payload_bytes") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    described = facts.join(owners.drop("pages"), "payload_key").withColumn("revisit", revisit)
    header = F.concat(
        F.lit("WARC/1.1" + _END),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _uri(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _uri(F.col("owner")))),
        _line("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(_END),
    )
    described.select(header.alias("header"), "payload_key").write.option("compression", "zstd").parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """payload_key and payload of each stored payload; reading one that doesn't match its key fails."""
    stored = spark.read.schema("payload_key string, payload binary").parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("payload_key")
    return stored.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_key")))))


def _field(name: str):
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header of each record with its payload's key, and what it says: page_id, url, record_type, refers_to."""
    said = lambda name: F.try_to_number(F.regexp_extract(F.coalesce(_field(name), F.lit("")), r"^<urn:page:(-?\d+)>$", 1), F.lit("S9999999999999999999")).cast("long")
    kept = spark.read.schema("header string, payload_key string").parquet(f"{path}/headers")
    return kept.select(
        "header",
        "payload_key",
        said("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        said("WARC-Refers-To").alias("refers_to")
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: the fields of read_headers, with block (the payload, empty for a revisit) and record, the bytes of the
    whole WARC record."""
    headers = read_headers(spark, path)
    revisits = headers.where(F.col("record_type") == "revisit").withColumn("block", F.lit(b""))
    # Of payloads from revisit_from bytes on there is one response; shorter ones meet theirs in SALTS groups.
    payloads = read_payloads(spark, path)
    salts = F.when(F.octet_length("payload") < REVISIT_FROM, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    length = F.coalesce(F.try_to_number(_field("Content-Length"), F.lit("9999999999999999999")), F.lit(0))
    salt = F.when(length < REVISIT_FROM, F.pmod(F.xxhash64("header"), F.lit(SALTS))).otherwise(0).cast("int")
    responses = headers.where(~F.col("record_type").eqNullSafe(F.lit("revisit"))).withColumn("salt", salt)
    responses = responses.join(
        payloads.select("payload_key", F.col("payload").alias("block"), F.explode(salts).alias("salt")), ["payload_key", "salt"]
    ).drop("salt")
    records = responses.unionByName(revisits)
    return records.withColumn("record", F.concat(F.encode("header", "UTF-8"), "block", F.lit(b"\r\n\r\n")))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """The fields of read_headers with payload_bytes and payload_digest (SHA-1) of the full payload. A response's are measured on its
    rebuilt record, cut at its header's end and Content-Length, a revisit's are those of the response that it refers to; a
    record whose length or digest isn't what its header says fails the read."""
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what} of record "), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    said = F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]{40})\r\n", 1)
    length = F.try_to_number(_field("Content-Length"), F.lit("9999999999999999999")).cast("long")
    head = F.octet_length("header")
    records = read_records(spark, path).select("header", "payload_key", "page_id", "url", "record_type", "refers_to", "record")
    whole = F.octet_length("record") == head + length + 4
    block = F.substr("record", head + 1, length.cast("int"))
    measured = records.withColumns({"payload_bytes": F.when(whole, length).otherwise(fail("length")), "payload_digest": F.sha1(block)}).drop("record")
    responses = measured.where(~F.col("record_type").eqNullSafe(F.lit("revisit")))
    responses = responses.withColumn("payload_digest", F.when(F.col("payload_digest") == said, F.col("payload_digest")).otherwise(fail("digest")))
    known = read_payloads(spark, path).where(F.octet_length("payload") >= REVISIT_FROM)
    known = known.select("payload_key", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    revisits = measured.where(F.col("record_type") == "revisit").drop("payload_bytes", "payload_digest").join(known, "payload_key")
    revisits = revisits.withColumn("payload_digest", F.when(F.col("payload_digest") == said, F.col("payload_digest")).otherwise(fail("digest")))
    return responses.unionByName(revisits)


def write_files(spark: SparkSession, path: str, target: str) -> None:
    """The archive's records as gzipped WARC members (path-free binary rows of about 64 MB together), in the Parquet column content;
    Spark has no writer for bare binary files, so a reader saves each row as a .warc.gz file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0).to_pylist():
                held.append(gzip.compress(record, 6, mtime=0))
                size += len(held[-1])
                if size >= 64 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])

    read_records(spark, path).select("record").mapInArrow(run, "content binary").write.parquet(target)


def parse_records(files: DataFrame) -> DataFrame:
    """The records of WARC files given as rows of (path, content), gzipped or not: path, header, block."""
    schema = pa.schema([("path", pa.string()), ("header", pa.string()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                at, found = 0, []
                while (start := data.find(b"WARC/", at)) >= 0 and (end := data.find(b"\r\n\r\n", start)) >= 0:
                    head = data[start : end + 4]
                    sizes = [line.split(b":", 1)[1] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
                    size = int(sizes[0]) if sizes else 0
                    found.append((path, head.decode("utf-8", "replace"), data[end + 4 : end + 4 + size]))
                    at = end + 4 + size
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, header string, block binary")

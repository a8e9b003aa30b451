"""Stateful guards of score streams: repeated keys are reported, tumbling windows summed with a quantile sketch.

Defined cases: a key's columns may be null, and null is a key; of a key's rows the first to arrive is the first, one whose time is
later than that by at most the horizon is a repeat, and a later one begins anew, whether or not the state was cleared by then. A row
with a null time belongs to no window and no horizon: it is left out. Rows older than the watermark are late and left out by Spark.
A window is given once, when the watermark passes its end; a window of failures alone has a null p95. Further columns of a guarded
row stay; an empty stream gives an empty table. State is dropped as the watermark passes, so it is bounded by what arrives
within the horizon (for repeats, by what had arrived within it when a bucket of keys last had rows). For the watermark of repeats
alone, times before 1677 or after 2262 count as the nearest between."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Size of the sketch, and the largest difference between the rank of its p95 and 0.95 that is promised of it.
SKETCH, RANK_ERROR = 800, 0.01
#: States that the keys of a guard are dealt to, and a microsecond, a day before the last one that pandas has a time for.
BUCKETS, _LAST = 1024, 9_223_285_636_854_775


def _text(value: Column, kind: T.DataType) -> Column:
    """A text that is the same for values that a grouping holds to be the same, and never null."""
    if isinstance(kind, T.StructType):
        inner = F.concat(F.lit("("), *[_text(value.getField(f.name), f.dataType) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        each = F.array_join(F.transform(value, lambda v: _text(v, kind.elementType)), "")
        inner = F.concat(F.size(value).cast("string"), F.lit("["), each)
    else:
        if isinstance(kind, T.StringType) and not kind.isUTF8BinaryCollation():
            raise ValueError(f"keys of a stream can't have the collation {kind.collation}")
        if isinstance(kind, T.BinaryType):
            value = F.hex(value)
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            value = value + F.lit(0.0).cast(kind)  # one zero
        elif isinstance(kind, T.TimestampType):
            value = F.unix_micros(value)
        value = value.cast("string")
        inner = F.concat(F.length(value).cast("string"), F.lit(":"), value)
    return F.coalesce(inner, F.lit("-"))


def _nested(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.AtomicType, T.NullType)) or isinstance(kind, T.VariantType)


def _sent(value: Column, kind: T.DataType) -> Column:
    """A value as bytes or text, which pass through pandas with nothing lost (long values beside nulls, NaN, late years)."""
    if isinstance(kind, T.BinaryType) or _nested(kind):
        return value
    if isinstance(kind, T.StringType):
        return value.cast("binary")
    return (F.unix_micros(value) if isinstance(kind, T.TimestampType) else value).cast("string")


def _received(value: Column, kind: T.DataType) -> Column:
    return F.timestamp_micros(value.cast("long")) if isinstance(kind, T.TimestampType) else value.cast(kind)


def _pickled(rows: DataFrame) -> DataFrame:
    """The rows with nested columns as bytes."""
    fields = [T.StructField(f.name, T.BinaryType() if _nested(f.dataType) else f.dataType) for f in rows.schema.fields]
    nested = {i for i, f in enumerate(rows.schema.fields) if _nested(f.dataType)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [
                pa.array([None if v is None else pickle.dumps(v) for v in a.to_pylist()], pa.binary()) if i in nested else a
                for i, a in enumerate(batch.columns)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return rows.mapInArrow(run, T.StructType(fields)) if nested else rows


def _unpickled(rows: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """The rows with the columns of these types made of what _pickled has made of them."""
    into = {name: to_arrow_type(kind) for name, kind in kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [
                pa.array([None if v is None else pickle.loads(v) for v in a.to_pylist()], into[name]) if name in into else a
                for name, a in zip(batch.schema.names, batch.columns)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    fields = [T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in rows.schema.fields]
    return rows.mapInArrow(run, T.StructType(fields)) if kinds else rows


def _guard(sent: list[str], horizon: int) -> Callable:
    """What a bucket does with its rows. Its state is the time of the first row of each key. Keys that the watermark has passed by the
    horizon are dropped with the bucket's next rows, or all together once it has passed the last one: not each time it moves, as
    then all buckets would be read and written, and a partition's be in memory at once."""

    def step(bucket: tuple, chunks: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = pickle.loads(state.get[0]) if state.exists else {}
        for chunk in chunks:
            repeats, begun = [], []
            for key, at in zip(chunk["__sg_key"].tolist(), chunk["__sg_micros"].tolist()):
                since = first.get(key)
                repeat = since is not None and at <= since + horizon
                if not repeat:
                    first[key] = since = at
                repeats.append(repeat)
                begun.append(since)
            yield chunk[sent].assign(is_repeat=repeats, __sg_begun=begun)
        passed = state.getCurrentWatermarkMs() * 1000 - horizon  # a row that isn't late begins these keys anew
        first = {key: at for key, at in first.items() if at > passed}
        if first:
            state.update((pickle.dumps(first),))
            state.setTimeoutTimestamp(max(1, (max(first.values()) + horizon) // 1000 + 1))
        elif state.exists:
            state.remove()

    return step


def guarded(rows: DataFrame, keys: list[str], horizon: timedelta, time: str = "ts", buckets: int = BUCKETS) -> DataFrame:
    """A stream's rows with is_repeat and first_time (the time of the row that they repeat, their own if they are first). Keys meet in
    buckets by a hash, as a call, a state and a timeout for each key cost more than all else: a bucket is called once a trigger and
    keeps its keys together, which must fit into memory. The number of buckets stays for the life of a checkpoint. State may be
    large; keep it in RocksDB (stateful_session)."""
    delay, width = f"{int(horizon.total_seconds())} seconds", int(horizon.total_seconds() * 1_000_000)
    fields, column = rows.schema.fields, lambda name: F.col(f"`{name.replace('`', '``')}`")
    kinds = {f.name: f.dataType for f in fields}
    sent = [f"__sg_{i}" for i in range(len(fields))]
    key = F.concat(F.lit(""), *[_text(column(name), kinds[name]) for name in keys]).cast("binary")
    timed = _pickled(
        rows.where(column(time).isNotNull()).select(
            *[_sent(column(f.name), f.dataType).alias(name) for name, f in zip(sent, fields)],
            key.alias("__sg_key"), F.unix_micros(column(time)).alias("__sg_micros"),
        )
    )
    at = F.greatest(F.least("__sg_micros", F.lit(_LAST)), F.lit(-_LAST))  # pandas has no times outside these
    dealt = timed.withColumn("__sg_at", F.timestamp_micros(at)).withColumn("__sg_bucket", F.pmod(F.xxhash64("__sg_key"), F.lit(buckets)).cast("int"))
    schema = T.StructType([*[f for f in timed.schema.fields if f.name in set(sent)], *T._parse_datatype_string("is_repeat boolean, __sg_begun long").fields])
    told = dealt.withWatermark("__sg_at", delay).groupBy("__sg_bucket").applyInPandasWithState(
        _guard(sent, width), schema, "first binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    back = _unpickled(told, {name: f.dataType for name, f in zip(sent, fields) if _nested(f.dataType)})
    own = [(F.col(name) if _nested(f.dataType) else _received(F.col(name), f.dataType)).alias(f.name) for name, f in zip(sent, fields)]
    return back.select(*own, "is_repeat", F.timestamp_micros("__sg_begun").alias("first_time"))


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that keeps streams' state in RocksDB; the given one stays as it is."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def window_metrics(scores: DataFrame, threshold: float, width: str, late: str) -> DataFrame:
    """Rows, failures, anomalous rows and their share, and the p95 of the scores that didn't fail, of each method in tumbling
    windows. State holds counts and a sketch for each window, whatever comes in."""
    failed = F.col("score_status") == "failed"
    said = F.coalesce(failed | (F.col("score") > threshold), F.lit(True))
    grouped = scores.where(F.col("ts").isNotNull()).withWatermark("ts", late).groupBy(F.window("ts", width), "method")
    summed = grouped.agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(failed).alias("failed_count"),
        F.count_if(said).alias("anomalous_count"),
        F.kll_sketch_agg_double(F.when(~failed, F.col("score").cast("double")), F.lit(SKETCH)).alias("sketch"),
    )
    some = F.kll_sketch_get_n_double("sketch") > 0
    return summed.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "method", "event_count", "failed_count", "anomalous_count",
        (F.col("anomalous_count") / F.col("event_count")).alias("anomalous_share"), F.when(
            some, F.kll_sketch_get_quantile_double("sketch", F.lit(0.95))
        ).alias("p95_score"),
    )


def p95_ranks(windows: DataFrame, scores: DataFrame, width: str) -> DataFrame:
    """The windows with p95_error: how far the rank of each one's p95 lies from 0.95 among the scores of that window that didn't fail,
    0 if 0.95 lies between the shares below it and up to it."""
    ok = scores.where(~(F.col("score_status") == "failed") & F.col("score").isNotNull()).select(
        F.window("ts", width)["start"].alias("window_start"), "method", "score"
    )
    met = ok.join(windows.select("window_start", "method", "p95_score"), ["window_start", "method"])
    ranks = met.groupBy("window_start", "method").agg(
        (F.count_if(F.col("score") < F.col("p95_score")) / F.count(F.lit(1))).alias("__sg_below"),
        (F.count_if(F.col("score") <= F.col("p95_score")) / F.count(F.lit(1))).alias("__sg_upto")
    )
    error = F.greatest(F.col("__sg_below") - 0.95, F.lit(0.95) - F.col("__sg_upto"), F.lit(0.0))
    return windows.join(ranks, ["window_start", "method"], "left").withColumn("p95_error", error).drop("__sg_below", "__sg_upto")


def drained(stream: DataFrame, path: str) -> None:
    """Run a stream in append mode over all that is there; a second run with the same path goes on where the first one stopped."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation", f"{path}/state"
    ).trigger(availableNow=True).start()
    query.awaitTermination()

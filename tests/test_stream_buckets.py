"""The guard of repeats keeps its keys in buckets: state that doesn't grow row by row, columns and keys of all kinds."""

import pickle
from datetime import date, datetime, timedelta
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoregate.streaming import guards

START = datetime(2024, 1, 1)
HORIZON = timedelta(minutes=10)


def told(spark, tmp_path, batches, keys, **more):
    """The rows that the guard gives over batches, each run to its end."""
    folder, own = f"file://{tmp_path}/in", guards.stateful_session(spark)
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
        stream = own.readStream.schema(batch.schema).parquet(folder)
        guards.drained(guards.guarded(stream, keys, HORIZON, **more), f"file://{tmp_path}/guard")
    return spark.read.parquet(f"file://{tmp_path}/guard/out")


def states(spark, tmp_path, rows):
    """The number of states after each trigger of a run over these rows and those before."""
    rows.write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = guards.stateful_session(spark).readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    query = guards.guarded(stream, ["item"], HORIZON).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option(
        "checkpointLocation", f"file://{tmp_path}/state"
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]


def test_many_keys_are_few_states(spark, tmp_path):
    n = 4000
    rows = spark.range(n).select(F.col("id").alias("item"), (F.lit(START) + F.make_dt_interval(secs=F.col("id") % 500)).alias("ts"))
    assert 0 < max(states(spark, tmp_path, rows)) < n / 2  # all keys are within the horizon
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert out.count() == n and out.where("is_repeat or first_time != ts").count() == 0


def test_states_go_as_the_watermark_passes(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("item"), F.lit(START).alias("ts"))
    assert states(spark, tmp_path, rows)[-1] > 100
    later = spark.range(1).select(F.lit(-1).cast("long").alias("item"), F.lit(START + timedelta(days=1)).alias("ts"))
    assert states(spark, tmp_path, later)[-1] == 1


def test_keys_of_a_bucket_go_with_its_next_rows():
    class State:  # what GroupState has
        exists, hasTimedOut, get, at, now = False, False, None, None, 0

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists = False

        def setTimeoutTimestamp(self, at):  # noqa: N802
            self.at = at

        def getCurrentWatermarkMs(self):  # noqa: N802
            return self.now

    state, step = State(), guards._guard(["__sg_0"], 10_000)
    chunk = lambda *rows: pd.DataFrame([(k, k, at) for k, at in rows], columns=["__sg_0", "__sg_key", "__sg_micros"])
    run = lambda *chunks: [tuple(r) for c in step((0,), list(chunks), state) for r in c.itertuples(index=False)]
    assert run(chunk((b"a", 1_000), (b"b", 2_000)), chunk((b"a", 11_000), (b"a", 11_001))) == [
        (b"a", False, 1_000), (b"b", False, 2_000), (b"a", True, 1_000), (b"a", False, 11_001),
    ]
    assert pickle.loads(state.get[0]) == {b"a": 11_001, b"b": 2_000} and state.at == 22
    state.now = 12  # b's horizon
    assert run(chunk((b"c", 12_500))) == [(b"c", False, 12_500)]
    assert pickle.loads(state.get[0]) == {b"a": 11_001, b"c": 12_500} and state.at == 23
    state.now = 40
    assert run(chunk()) == [] and not state.exists


def test_repeats_of_keys_that_share_a_bucket(spark, tmp_path):
    at = lambda c: F.lit(START) + F.make_dt_interval(mins=c)
    first = spark.range(500).select(F.col("id").alias("item"), at(F.col("id") % 5).alias("ts"))
    then = spark.range(0, 1000, 2).select(F.col("id").alias("item"), at(F.lit(12)).alias("ts"))  # more than ten minutes after 0 and 1
    out = told(spark, tmp_path, [first, then], ["item"], buckets=3)
    got = {r["item"]: r for r in out.where(F.col("ts") == F.lit(START + timedelta(minutes=12))).collect()}
    assert out.count() == 1000 and sorted(got) == list(range(0, 1000, 2))
    for item, r in got.items():
        repeat = item < 500 and item % 5 >= 2
        assert r["is_repeat"] == repeat
        assert r["first_time"] == START + timedelta(minutes=item % 5 if repeat else 12)


def test_columns_of_all_kinds_stay(spark, tmp_path):
    schema = (
        "item long, ts timestamp, b boolean, i int, n long, f float, x double, d decimal(20,4), day date, other timestamp, local timestamp_ntz, "
        "raw binary, note string, `a.b` string, list array<long>, inner struct<k:long, at:timestamp, l:array<string>>, m map<int,double>, none array<int>"
    )
    odd = datetime(2024, 1, 1, 0, 0, 0, 1)
    full = (
        True, -7, 2**60 + 1, 1.5, float("inf"), Decimal("1234567890123456.7891"), date(1, 1, 1), datetime(9999, 12, 30), datetime(1500, 1, 1, 2),
        bytearray(b"\x00\xff"), "NaN", "", [2**60 + 1, None], (None, odd, ["x", None]), {1: None, 2: -0.0}, None,
    )
    nulls = (None,) * 16
    nan = (False, 0, 0, 0.0, float("nan"), Decimal(0), date(2024, 1, 1), odd, odd, bytearray(), "", None, [], (1, None, None), {}, [None, 3])
    rows = [(1, odd, *full), (2, START, *nulls), (3, START, *nan), (2**60 + 1, START, *nulls), (2**60 + 2, START, *nulls)]
    df = spark.createDataFrame(rows, schema)
    out = told(spark, tmp_path, [df], ["item"])
    assert out.columns == [*df.columns, "is_repeat", "first_time"]
    assert [f.dataType for f in out.schema.fields[:-2]] == [f.dataType for f in df.schema.fields]
    assert sorted(map(repr, out.select([f"`{c}`" for c in df.columns]).collect())) == sorted(map(repr, df.collect()))
    assert out.where("is_repeat").count() == 0
    assert out.where("first_time = ts").count() == 5


def test_keys_are_the_same_as_a_grouping_holds_them_to_be(spark, tmp_path):
    nan = float("nan")
    schema = "x double, s struct<a:string,b:array<double>>, u string, note string, ts timestamp"
    keys = [
        (nan, None, ""), (0.0, (None, None), ""), (1.0, ("a", [0.0, nan]), ""), (1.0, ("a", [0.0, nan]), None), (1.0, ("a", []), None),
        (1.0, ("a", None), None), (None, None, "-"), (None, None, None), (None, None, "1:-"), (None, ("1", [None]), "-"),
    ]
    first = [(*k, "first", START) for k in keys]
    same = {0.0: -0.0}.get
    again = [(same(x, x), t and (t[0], t[1] and [same(v, v) for v in t[1]]), u, "again", START) for x, t, u in keys]
    out = told(spark, tmp_path, [spark.createDataFrame(first, schema), spark.createDataFrame(again, schema)], ["x", "s", "u"])
    got = {(r["note"], r["is_repeat"]): r["count"] for r in out.groupBy("note", "is_repeat").count().collect()}
    assert got == {("first", False): len(keys), ("again", True): len(keys)}
    folded = spark.readStream.schema("item string collate UTF8_LCASE, ts timestamp").parquet(f"file://{tmp_path}/in")
    with pytest.raises(ValueError, match="collation"):
        guards.guarded(folded, ["item"], HORIZON)


def test_times_beyond_those_of_pandas(spark, tmp_path):
    far = datetime(9999, 1, 1)
    df = spark.createDataFrame([(1, START), (2, far)], "item long, ts timestamp")
    again = spark.createDataFrame([(2, far + timedelta(minutes=1)), (3, far + timedelta(minutes=2))], "item long, ts timestamp")
    got = {(r["item"], r["ts"]): (r["is_repeat"], r["first_time"]) for r in told(spark, tmp_path, [df, again], ["item"]).collect()}
    assert got == {
        (1, START): (False, START), (2, far): (False, far), (2, far + timedelta(minutes=1)): (True, far),
        (3, far + timedelta(minutes=2)): (False, far + timedelta(minutes=2)),
    }


def test_an_empty_stream_gives_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "item long, ts timestamp, l array<int>")
    df.write.parquet(f"file://{tmp_path}/in")
    stream = guards.stateful_session(spark).readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    guarded = guards.guarded(stream, ["item"], HORIZON)
    guards.drained(guarded, f"file://{tmp_path}/guard")
    assert spark.read.schema(guarded.schema).parquet(f"file://{tmp_path}/guard/out").count() == 0

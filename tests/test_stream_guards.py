"""Guards of streams: repeats inside and outside the horizon, windows over batches with late rows."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from scoregate.streaming import guards

START = datetime(2024, 1, 1)
SCHEMA = "method string, item long, ts timestamp, score_status string, score double, note string"


def stream(session, folder):
    return session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_repeats_are_reported_with_the_first_rows_time(spark, tmp_path):
    folder, path = f"file://{tmp_path}/in", f"file://{tmp_path}/guard"
    at = lambda m: START + timedelta(minutes=m)
    own = guards.stateful_session(spark)
    row = lambda item, m: ("m", item, at(m) if m is not None else None, "ok", 1.0, f"n{m}")
    batches = [
        [row(1, 0), row(2, 0), row(None, 1), row(9, None)],
        [row(1, 5), row(2, 11), row(None, 2), row(3, 30)],  # 2 comes again beyond ten minutes
        [row(1, 31), row(2, 12), row(3, 40), row(3, 41), row(4, 45)],  # 1 anew; 2 at minute 12 is late, 3 repeats once, then anew
        [row(4, 46), row(1, 33), row(1, 41)],
    ]
    for rows in batches:
        put(spark, folder, rows)
        guards.drained(guards.guarded(stream(own, folder), ["item"], timedelta(minutes=10)), path)
    got = Counter((r["item"], r["note"], r["is_repeat"], r["first_time"]) for r in spark.read.parquet(f"{path}/out").collect())
    want = [
        (1, "n0", False, at(0)), (2, "n0", False, at(0)), (
            None, "n1", False, at(1)
        ), (1, "n5", True, at(0)), (2, "n11", False, at(11)), (None, "n2", True, at(1)),
        (
            3, "n30", False, at(30)
        ), (
            1, "n31", False, at(31)
        ), (3, "n40", True, at(30)), (
            3, "n41", False, at(41)
        ), (4, "n45", False, at(45)), (4, "n46", True, at(45)), (1, "n41", True, at(31)),
    ]
    # minute 33 comes when the watermark is 35, and is late as minute 12 was at 20
    assert {k: n for k, n in got.items()} == Counter(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_windows_over_batches_with_late_rows(spark, tmp_path):
    folder, path = f"file://{tmp_path}/in", f"file://{tmp_path}/windows"
    rng = np.random.default_rng(4)

    def rows(first, n):
        return [
            (
                "ab"[i % 2],
                i,
                START + timedelta(minutes=float(first + rng.random() * 60)),
                "failed" if i % 10 == 0 else "ok",
                float(rng.normal()),
                ""
            )
            for i in range(n)
        ]

    batches = [rows(0, 4000), rows(60, 3000) + rows(0, 50), rows(180, 100) + rows(0, 70)]  # 50 in time, 70 late
    for batch in batches:
        put(spark, folder, batch)
        guards.drained(guards.window_metrics(stream(spark, folder), 1.0, "1 hour", "55 minutes"), path)
    out = spark.read.parquet(f"{path}/out")
    kept = batches[0] + batches[1]
    scores = spark.createDataFrame(kept, SCHEMA)
    got = {(r["method"], r["window_start"]): r for r in guards.p95_ranks(out, scores, "1 hour").collect()}
    assert len(got) == out.count() == 4  # the last hour is still open
    for (method, start), r in got.items():
        own = [x for x in kept if x[0] == method and start <= x[2] < start + timedelta(hours=1)]
        assert r["event_count"] == len(own)
        assert r["failed_count"] == sum(x[3] == "failed" for x in own)
        assert r["anomalous_count"] == sum(x[3] == "failed" or x[4] > 1.0 for x in own) == round(r["anomalous_share"] * len(own))
        good = np.array([x[4] for x in own if x[3] == "ok"])
        assert abs((good <= r["p95_score"]).mean() - 0.95) <= guards.RANK_ERROR
        assert r["p95_error"] <= guards.RANK_ERROR


def test_window_of_failures_alone(spark, tmp_path):
    folder, path = f"file://{tmp_path}/in", f"file://{tmp_path}/windows"
    put(spark, folder, [("m", 1, START, "failed", None, ""), ("m", 2, START + timedelta(days=1), "ok", 1.0, "")])
    guards.drained(guards.window_metrics(stream(spark, folder), 1.0, "1 hour", "1 minute"), path)
    [r] = spark.read.parquet(f"{path}/out").collect()
    assert (r["event_count"], r["failed_count"], r["anomalous_count"], r["p95_score"]) == (1, 1, 1, None)

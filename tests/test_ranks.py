"""Selection by rank under ties: results as by sorting, and no range with more than a stated share of a group's rows."""

import random

import pytest
from pyspark.sql import functions as F

from scoregate.operators import prefix, scores

N = 60_000


@pytest.fixture(autouse=True)
def groups_are_large(monkeypatch):
    monkeypatch.setattr(prefix, "SMALL", 2048)


@pytest.fixture(scope="module")
def tied(spark):
    """One score for nine tenths of a method's rows; a method with all scores and items alike; a small one; nulls."""
    rng = random.Random(3)
    rows = [("tied", i * 7919 % N, 0.5 if i % 10 else rng.random()) for i in range(N)] + [("same", 1, 2.0)] * 20_000
    rows += [(None, i, None if i % 3 == 0 else float(i % 5)) for i in range(50)]
    return rows, spark.createDataFrame(rows, "method string, item long, score double").repartition(4).cache()


@pytest.mark.parametrize("quantile", [0.02, 0.5, 0.95])
def test_thresholds_under_ties(tied, quantile):
    rows, df = tied
    got = {r["method"]: (r["item_count"], r["threshold_rank"], r["threshold"], r["threshold_item"]) for r in scores.thresholds(df, quantile).collect()}
    for method in ("tied", "same", None):
        own = sorted((s, i) for m, i, s in rows if m == method and s is not None)
        rank = -int(-(quantile * len(own)) // 1)
        assert got[method] == (len(own), rank, own[rank - 1][0], own[rank - 1][1])


def test_no_range_holds_more_than_three_shares(tied):
    _, df = tied
    held = prefix.held(df, ["method", "score", "item"])
    sizes = prefix.ranged(held, ["method"], ["score", "item", prefix._ROW]).where("method is not null").groupBy("method", "__sg_range").count().collect()
    for method, n in (("tied", N), ("same", 20_000)):
        own = [r["count"] for r in sizes if r["method"] == method]
        assert sum(own) == n and max(own) <= 3 * n / prefix.RANGES and len(own) > prefix.RANGES // 2


def test_running_sums_with_ties(tied):
    rows, df = tied
    steps = df.where("method = 'tied'").groupBy("method", "score").agg(F.count(F.lit(1)).alias("n"))
    up = {r["score"]: r["upto"] for r in prefix.running(steps, ["method"], "score", {"upto": F.col("n")}).collect()}
    down = {r["score"]: r["upto"] for r in prefix.running(steps, ["method"], "score", {"upto": F.col("n")}, descending=True).collect()}
    values = sorted(s for m, _, s in rows if m == "tied")
    for at in (0, 100, N // 2, N - 1):
        s = values[at]
        assert up[s] == sum(v <= s for v in values) and down[s] == sum(v >= s for v in values)


def test_medians_are_exact(tied):
    rows, df = tied
    got = {r["method"]: (r["median"], r["high"]) for r in prefix.median_and_more(df, ["method"], "score", {"high": 0.95}).collect()}
    for method in ("tied", "same", None):
        own = sorted(s for m, _, s in rows if m == method and s is not None)
        n = len(own)
        assert got[method] == ((own[(n - 1) // 2] + own[n // 2]) / 2, own[-int(-(0.95 * n) // 1) - 1])


def test_empty(spark):
    empty = spark.createDataFrame([], "method string, item long, score double")
    assert scores.thresholds(empty).collect() == []
    assert prefix.running(empty, ["method"], "score", {"n": F.lit(1)}).collect() == []

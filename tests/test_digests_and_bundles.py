"""Running digests of large groups, comparison by ranges of hashes, and bundles that are committed by a record."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scoregate.operators import inventory as inv, reproduce
from scoregate.sources import bundles


def test_running_digest_is_the_digest_of_the_lines(spark):
    rows = [(g, f"k{i:05d}", None if i % 11 == 3 else f"é{i}" * (i % 4)) for g in ("a", "b", None, "") for i in range(700)] + [("nothing", "k", None)]
    df = spark.createDataFrame(rows, "g string, k string, line string").repartition(7)
    got = {r["g"]: r["digest"] for r in inv.flat_digest(df, ["g"], "k", F.col("line")).collect()}
    for g in {r[0] for r in rows}:
        own = [x for h, _, x in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]) if x is not None]
        assert got[g] == (hashlib.sha256("".join(x + "\n" for x in own).encode()).hexdigest() if own else None)
    assert inv.flat_digest(df.limit(0), ["g"], "k", F.col("line")).collect() == []


def test_running_digest_equals_listagg_and_holds_no_group(spark):
    df = spark.range(300_000).select((F.col("id") % 2).alias("g"), F.lpad(F.col("id").cast("string"), 8, "0").alias("k"))
    line = inv.tree_line(F.col("k"), F.md5("k"), F.length("k"))
    out = inv.flat_digest(df, ["g"], "k", line)
    want = df.withColumn("line", line).groupBy("g").agg(F.sha2(F.expr("listagg(concat(line, '\n'), '') WITHIN GROUP (ORDER BY k)"), 256).alias("digest"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan


def test_one_changed_row_moves_one_range(spark):
    a = spark.range(50_000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") * 2).alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 777, F.lit(-1)).otherwise(F.col("v")))
    gone, new, moved = reproduce.only_differing(a, b)
    assert moved.count() <= 2 and gone.count() < 100
    assert [tuple(r) for r in gone.exceptAll(new).collect()] == [(777, None)] and [tuple(r) for r in new.exceptAll(gone).collect()] == [(777, -1)]
    assert reproduce.only_differing(a, a.repartition(5))[2].isEmpty()


def test_comparison_counts_repeats_and_tells_nulls_apart(spark):
    a = spark.createDataFrame([(1, None), (None, 1), (2, 2), (2, 2), (3, 3)], "x int, y int")
    b = spark.createDataFrame([(None, 1), (None, 1), (2, 2), (3, 3), (3, 3)], "x int, y int")
    got = Counter((r["side"], r["row_json"]) for r in reproduce.recomputed_violations(a, b, "t").collect())
    assert got == {
        ("stored_only", '{"x":1,"y":null}'): 1,
        ("stored_only", '{"x":2,"y":2}'): 1,
        ("fresh_only", '{"x":null,"y":1}'): 1,
        ("fresh_only", '{"x":3,"y":3}'): 1
    }
    assert reproduce.recomputed_violations(a, a, "t").collect() == [] and reproduce.recomputed_violations(a.limit(0), a.limit(0), "t").collect() == []


STEPS = ("write_bundle", "state_digest", "_create")


@pytest.mark.parametrize("step", STEPS)
def test_a_crash_at_any_step_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    path = f"file://{tmp_path}/b"
    table = lambda n: {"t": spark.createDataFrame([("m", i) for i in range(n)], "method string, x int")}
    with pytest.raises(FileNotFoundError):
        bundles.open_bundle(spark, path)
    assert bundles.publish(table(2), path) == 1
    before = bundles.open_bundle(spark, path)

    def crash(*args, **more):
        if step == "write_bundle":  # half of what it writes is there
            whole(*args, **more)
        raise RuntimeError("lost")

    whole = getattr(bundles, step)
    monkeypatch.setattr(bundles, step, crash)
    with pytest.raises(RuntimeError, match="lost"):
        bundles.publish(table(3), path, replaces=1)
    monkeypatch.undo()
    assert bundles.open_bundle(spark, path) == before
    assert spark.read.parquet(f"{before[1]}/t").count() == 2
    assert bundles.publish(table(3), path, replaces=1) == 2
    assert bundles.bundle_violations(spark, bundles.open_bundle(spark, path)[1], {"t": table(1)["t"].schema}).count() == 0


def test_a_second_writer_is_refused_and_a_torn_record_is_no_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/b"
    table = {"t": spark.createDataFrame([("m", 1)], "method string, x int")}
    bundles.publish(table, path)
    for replaces in (None, 2):
        with pytest.raises(FileExistsError):
            bundles.publish(table, path, replaces=replaces)
    seen = bundles._committed
    monkeypatch.setattr(bundles, "_committed", lambda spark, path: {} if not calls.append(1) else {})
    calls = []
    with pytest.raises(FileExistsError):  # both writers saw nothing; the record of one is there
        bundles.publish(table, path)
    monkeypatch.setattr(bundles, "_committed", seen)
    (tmp_path / "b/commits/000000002.json").write_text('{"body": "{\\"version\\": 2, \\"att')
    assert bundles.open_bundle(spark, path)[0] == 1

"""No operator loses a row: nulls, unknown methods, missing and repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F

from scoregate.functions import scalars as S
from scoregate.operators import contracts as c, evaluation as ev, inventory as inv, partition, pivots, prefix, reproduce, scores as sc, vectors as v
from scoregate.sources import bundles, files, stages

SCORE = "method string, item long, score_status string, failure_code string, score double"


def rows(df, *columns):
    return sorted((tuple(r[k] for k in columns or df.columns) for r in df.collect()), key=str)


def test_a_repetition_with_missing_extra_and_repeated_rows(spark):
    expected = spark.createDataFrame([("m", 1, "ok", None, 0.5), ("m", 2, "ok", None, 0.5), ("m", 2, "ok", None, 0.6), (None, 3, "ok", None, 0.1)], SCORE)
    again = spark.createDataFrame([("m", 1, "ok", None, 0.5), ("m", 2, "ok", None, 0.5), ("m", 9, "ok", None, 0.5), (None, 3, "ok", None, 0.1)], SCORE)
    got = reproduce.compared(expected, again, ["method", "item"])
    assert rows(got, "method", "item", "pair_state", "within_tolerance") == sorted(
        [
            ("m", 1, "compared", True),
            ("m", 2, "compared", True),
            ("m", 2, "absent", False),
            ("m", 9, "extra", False),
            (None, 3, "compared", True)
        ],
        key=str
    )
    assert rows(
        reproduce.reproduction_summary(got), "method", "compared_count", "absent_count", "extra_count", "reproduced"
    ) == sorted([("m", 2, 1, 1, False), (None, 1, 0, 0, True)], key=str)
    assert reproduce.compared(expected.limit(0), again.limit(0), ["method", "item"]).count() == 0


def test_unknown_methods_fail_closed(spark):
    raw = spark.createDataFrame(
        [("m", 1, "ok", None, 0.5), ("x", 2, "ok", None, 0.5), (None, 3, "ok", None, 0.5), ("m", 4, None, None, None)], SCORE
    ).withColumn("_bad", F.lit(1))
    rules = spark.createDataFrame([("m", 0.0, 1.0, True, 1.0)], "method string, low double, high double, inclusive boolean, failure_score double")
    got = sc.with_failures(raw, rules)
    assert rows(got, "item", "score_status", "failure_code", "score") == [
        (1, "ok", None, 0.5),
        (2, "failed", "METHOD_UNKNOWN", None),
        (3, "failed", "METHOD_UNKNOWN", None),
        (4, "failed", "SCORE_INVALID", 1.0)
    ]
    assert rows(sc.state_violations(raw, rules), "item", "rule") == [(2, "unknown_method"), (3, "unknown_method"), (4, "score_not_finite")]
    cuts = spark.createDataFrame([("m", 0.7)], "method string, threshold double")
    assert rows(sc.classify(raw, cuts), "item", "is_anomalous", "decision_reason") == [
        (1, False, "within_threshold"), (2, True, "threshold_missing"), (3, True, "threshold_missing"), (4, True, "score_missing")
    ]
    for out in (
        sc.with_failures(raw.limit(0), rules),
        sc.state_violations(raw.limit(0), rules),
        sc.classify(raw.limit(0), cuts),
        sc.thresholds(raw.limit(0)),
        sc.class_counts(sc.classify(raw.limit(0), cuts))
    ):
        assert out.count() == 0


def test_label_free_summary_counts_partners_that_are_missing(spark):
    s = spark.createDataFrame([("m", 1, "ok", None, 0.5), ("m", 2, "ok", None, 0.6)], SCORE)
    classes = sc.classify(s.where("item = 1"), spark.createDataFrame([("m", 0.7)], "method string, threshold double"))
    passes = s.unionByName(s.withColumn("item", F.lit(7).cast("long")).limit(1)).withColumn("duration", F.col("item") * 1.0)
    r = reproduce.label_free_summary(s, classes, passes).first()
    assert (r["item_count"], r["classification_agrees"], r["observation_count"], r["passes_agree"], r["median_duration"]) == (2, False, 3, False, 2.0)


def test_partitions_keep_rows_with_nulls(spark):
    t = spark.createDataFrame(
        [("a", "p1"), ("a", None), (None, "p2"), (None, "p3"), ("a", "p1")], "category string, path string"
    ).withColumn("_range", F.lit(0)).withColumn("_o", F.lit(0))
    got = partition.seeded_partitions(t, "n", 1, 1, "category", "path")
    assert got.count() == 5 and rows(got.groupBy("category").agg(F.max("selection_rank").alias("m"))) == [("a", 3), (None, 2)]
    assert rows(partition.opaque_order(t, bytes(32), "path"), "asset_id") == [(f"asset-{i:06d}",) for i in range(5)]
    assert partition.opaque_order(t.limit(0), bytes(32), "path").count() == 0 and prefix.ordinals(t.limit(0), ["category"], ["path"]).count() == 0
    assert rows(prefix.ordinals(t, ["category"], ["path"]), "category", "path", "ordinal") == [
        ("a", "p1", 2), ("a", "p1", 3), ("a", None, 1), (None, "p2", 1), (None, "p3", 2)
    ]


def test_a_split_goes_to_two_roots_apart(spark, tmp_path):
    t = spark.createDataFrame([("a/1", "x", 3), ("a/2", "y", 4)], "path string, label string, size int")
    with pytest.raises(ValueError, match="outside"):
        partition.write_split(t, bytes(32), "path", "label", ["size"], f"file://{tmp_path}/r", f"file://{tmp_path}/r/sealed")
    partition.write_split(t, bytes(32), "path", "label", ["size"], f"file://{tmp_path}/i", f"file://{tmp_path}/s")
    items, sealed = spark.read.parquet(f"file://{tmp_path}/i"), spark.read.parquet(f"file://{tmp_path}/s")
    assert set(items.columns) & set(sealed.columns) == {"asset_id"} and rows(items.join(sealed, "asset_id"), "source_path", "size") == [("a/1", 3), ("a/2", 4)]


def test_vectors_of_the_wrong_size_become_failed_items(spark):
    t = spark.createDataFrame(
        [(1, [1.0, 0.0, 0.0, 1.0]), (2, None), (3, [1.0]), (4, [1.0, 0.0, 1.0]), (5, [0.0, None, 1.0, 0.0])],
        "item long, v array<double>"
    )
    patched = v.patches(t, "item", "v", 2)
    assert rows(
        patched.groupBy("item").agg(F.min("position").alias("p"), F.count(F.lit(1)).alias("n"))
    ) == [(1, 0, 2), (2, -1, 1), (3, -1, 1), (4, -1, 1), (5, 0, 2)]
    bank = spark.createDataFrame([([1.0, 0.0],)], "patch array<double>")
    scored = v.item_scores(v.nearest_distances(patched, "item", bank), "item", "distance", 1.0, "ceil")
    assert rows(scored) == [(1, 0.5), (2, None), (3, None), (4, None), (5, None)]
    assert rows(v.item_scores(v.nearest_distances(patched, "item", bank.limit(0)), "item", "distance", 1.0, "ceil"))[0] == (1, None)
    assert v.nearest_distances(patched.limit(0), "item", bank).count() == 0
    assert rows(v.tiles(t, "item", "v", 2, 2, (1, 2), (1, 1)).groupBy("item").agg(F.min("tile_row").alias("r"))) == [(1, 0), (2, -1), (3, -1), (4, -1), (5, 0)]
    z = v.position_zscores(patched, "item", v.position_scalers(patched.where("item = 1 and position = 0")))
    assert {r["item"] for r in z.collect()} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("most", [0, 4096])
def test_nearest_distances_by_blocks_and_by_broadcast(spark, monkeypatch, most):
    for where, name, value in ((v, "BROADCAST_ROWS", most), (v, "BLOCK", 7), (pivots, "QUERIES", 10), (pivots, "PIECE_BYTES", 160)):
        monkeypatch.setattr(where, name, value)
    t = spark.range(60).select(F.col("id").alias("item"), F.array(F.sin(F.col("id") * 1.0), F.cos(F.col("id") * 3.0), F.sin(F.col("id") * 0.7 + 1)).alias("v"))
    bank = v.bank(v.patches(t.where("item < 20"), "item", "v", 3))
    got = {r["item"]: r["distance"] for r in v.nearest_distances(v.patches(t, "item", "v", 3), "item", bank).collect()}
    vectors = {r["item"]: r["v"] for r in t.collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    assert all(abs(got[i] - min(max(1 - cos(vectors[i], vectors[k]), 0) for k in range(20))) < 1e-9 for i in vectors)


def test_ranks_and_medians_by_sorting(spark):
    t = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("g"),
        F.when(F.col("id") % 50 > 0, (F.col("id") * 7919 % 1013).cast("double")).alias("x"),
        F.col("id").alias("_range")
    )
    held = {}
    for r in t.collect():
        if r["x"] is not None:
            held.setdefault(r["g"], []).append(r["x"])
    for r in prefix.median_and_more(t, ["g"], "x", {"p95": 0.95}).collect():
        s = sorted(held[r["g"]])
        assert r["median"] == (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 and r["p95"] == s[-(-95 * len(s) // 100) - 1]
    assert prefix.median_and_more(t.limit(0), ["g"], "x").count() == 0
    sums = prefix.running(t.where("x is not null"), ["g"], "x", {"upto": F.lit(1)}).collect()
    assert all(r["upto"] == sum(y <= r["x"] for y in held[r["g"]]) for r in sums[:200]) and len(sums) == sum(map(len, held.values()))


def test_reveal_and_decision_without_partners(spark):
    items = spark.createDataFrame([(1,), (1,), (None,)], "item long")
    labels = spark.createDataFrame([(1, "normal"), (None, "anomaly")], "item long, true_class string")
    assert ev.reveal_status(items, labels).first()["status_code"] == "ITEMS_DUPLICATE"
    assert ev.reveal_status(items.limit(0), labels.limit(0)).first()["status_code"] == "LABELS_EMPTY"
    gated = ev.gates(
        spark.createDataFrame(
            [("m", 0.0, 1.0, 0.1, 20.0, 0.0, 1.0)],
            "method string, fpr double, recall double, p95_duration double, reference_count double, anomaly_training_labels double, reproduced double"
        )
    )
    none = spark.createDataFrame([], "method string, leakage boolean, contradicted boolean, guardrail boolean, condition string")
    assert rows(ev.decide(gated, none), "method", "decision", "evidence_valid") == [("m", "REJECT", False)]
    assert rows(
        ev.metrics_with_latency(
            spark.createDataFrame([("a", 3), ("b", 3)], "method string, item_count long"),
            spark.createDataFrame([("b", 4), ("c", 1)], "method string, item_count long")
        ),
        "method",
        "evidence_state"
    ) == [("a", "latency_missing"), ("b", "item_count"), ("c", "metrics_missing")]


def test_inventories_with_null_keys_and_missing_nodes(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, None)], "k long, f string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (3, None), (4, "z")], "k long, f string")
    assert rows(inv.reconcile(a, b, "k", ["f"])) == [(4, "extra")] and rows(inv.evidence(a, b, "k", ["f"]), "verification") == [("verified",)] * 3
    edges = spark.range(100).select((F.col("id")).cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    start = spark.createDataFrame([("0",)], "node string")
    assert inv.closure(start, edges).agg(F.max("depth")).first()[0] == 100
    with pytest.raises(ValueError, match="100"):
        inv.closure(start, edges, edges.select(F.col("src").alias("node")))


def test_files_say_what_is_wrong(spark, tmp_path):
    base = f"file://{tmp_path}"
    t = spark.createDataFrame([("m", 1), ("m", 2), ("n", 2)], "method string, rank long")
    files.write_csv(t, f"{base}/c", ["method", "rank"])
    assert files.read_exactly(spark, f"{base}/c", t.schema, {"m": 2, "n": 1}).count() == 3
    for wrong in ({"m": 2}, {"m": 2, "n": 2}, {"m": 2, "n": 1, "o": 1}):
        with pytest.raises(ValueError, match="rows"):
            files.read_exactly(spark, f"{base}/c", t.schema, wrong)
    with pytest.raises(ValueError, match="'n'"):
        files.read_ranked(spark, f"{base}/c", t.schema, ["method"], "rank")
    files.write_json(spark, {"b": 1, "a": ["é", None]}, f"{base}/j")
    assert files.read_json(spark, f"{base}/j") == {"a": ["é", None], "b": 1}
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_json(spark, {}, f"{base}/j")
    (tmp_path / "s.csv").write_bytes("﻿object,split,label,image,mask\r\na,train,normal,a/1.png,\r\nb,test,anomaly,a/2.png,\"m,1\"\r\n".encode())
    digest = spark.read.format("binaryFile").load(f"{base}/s.csv").select(F.sha2("content", 256)).first()[0]
    got = files.read_split(spark, f"{base}/s.csv", "a", digest)
    assert rows(got, "source_row", "object", "mask") == [(2, "a", None)]
    with pytest.raises(ValueError, match="digest"):
        files.read_split(spark, f"{base}/s.csv", "a", "0" * 64)


def test_a_bundle_is_whole_or_absent(spark, tmp_path):
    good = spark.createDataFrame([("m", 1), (None, 2)], "method string, x long")
    bad = good.withColumn("x", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        bundles.write_bundle({"good": good, "bad": bad}, f"file://{tmp_path}/b")
    assert not list(tmp_path.iterdir())
    bundles.write_bundle({"good": good}, f"file://{tmp_path}/b")
    with pytest.raises(FileExistsError):
        bundles.write_bundle({"good": good}, f"file://{tmp_path}/b")
    assert bundles.bundle_violations(
        spark, f"file://{tmp_path}/b", {"good": good.schema}
    ).count() == 0 and bundles.read_manifest(spark, f"file://{tmp_path}/b").count() == 2


def test_objects_and_equal_json(spark):
    t = spark.createDataFrame([('{"a":1,"b":[2]}', '{ "b" : [2], "a": 1 }'), ("[1]", "[1]"), ("{", "{"), (None, None), ("1", "2")], "a string, b string")
    got = [(r["o"], r["s"]) for r in t.select(S.is_object(F.col("a")).alias("o"), S.same_json(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [(True, True), (False, True), (False, False), (False, False), (False, False)]


def test_contracts_over_empty_tables_and_nulls(spark):
    t = spark.createDataFrame([], "method string, item long, p long, run string")
    assert rows(c.collection_violations(t, ["method", "item"], ["run"], ["method"], "p"), "rule") == [("empty",)]
    n = spark.createDataFrame([(None, None, None, "r")], t.schema)
    assert ("gap",) in rows(c.collection_violations(n, ["method", "item"], ["run"], ["method"], "p"), "rule")
    s = spark.createDataFrame([("m", 1, "ok", None, 0.5)], SCORE)
    classed = sc.classify(s, spark.createDataFrame([("m", 0.7)], "method string, threshold double"))
    assert c.semantic_violations(classed).count() == 0 and c.semantic_violations(classed.withColumn("score_margin", F.lit(None).cast("double"))).count() == 1
    assert c.split_violations(spark.createDataFrame([("train", None), (None, "normal"), ("test", "anomaly")], "split string, label string")).count() == 2


def test_the_shared_folder_is_never_local_on_a_cluster():
    class Unset:
        """Stands for the context and what it gives on the way to its checkpoint folder, which is not set."""

        master = "spark://somewhere:7077"
        _jsc = property(lambda self: self)

        def sc(self):
            return self

        def getCheckpointDir(self):  # noqa: N802
            return self

        def isDefined(self):  # noqa: N802
            return False

    class Session:
        sparkContext = Unset()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        stages.shared_dir(Session())

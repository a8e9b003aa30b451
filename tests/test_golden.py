"""Published values on small inputs, and one broken row for each rule."""

import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from scoregate.functions import scalars as S
from scoregate.operators import contracts, evaluation as ev, inventory, partition, reproduce, scores as sc, vectors


def score_rows(spark, rows, method="m"):
    return spark.createDataFrame(
        [(method, i, s, c, float(x)) for i, (x, s, c) in enumerate(rows)],
        "method string, item long, score_status string, failure_code string, score double"
    )


def revealed(spark, labels, scores, threshold=0.5, failed=()):
    rows = [
        (
            "m",
            i,
            "failed" if i in failed else "ok",
            float(s),
            bool(s > threshold or i in failed),
            "anomaly" if y == "a" else "normal"
        )
        for i, (y, s) in enumerate(zip(labels, scores))
    ]
    return spark.createDataFrame(rows, "method string, item long, score_status string, score double, is_anomalous boolean, true_class string")


@pytest.mark.parametrize("n,rank", [(1, 1), (7, 7), (20, 19), (300, 285), (600, 570), (881, 837), (884, 840)])
def test_nearest_rank(spark, n, rank):
    rows = spark.range(n).select(F.lit("m").alias("method"), F.col("id").alias("item"), (F.col("id") * 37 % n).cast("double").alias("score"))
    got = sc.thresholds(rows).first()
    assert (got["item_count"], got["threshold_rank"], got["threshold"]) == (n, rank, float(rank - 1))


def test_threshold_source_row_breaks_ties_by_item(spark):
    rows = spark.createDataFrame([("m", i, 0.19 if i > 3 else 0.01 * i) for i in range(20)], "method string, item long, score double")
    got = sc.thresholds(rows).first()
    assert (got["threshold"], got["threshold_item"]) == (0.19, 18)


def test_synthetic_calibration(spark):
    rows = spark.createDataFrame([("m", f"{i:04d}.png", i / 100) for i in range(1, 21)], "method string, item string, score double")
    assert sc.thresholds(rows).first()["threshold"] == 0.19


@pytest.mark.parametrize(
    "labels,scores,auroc,ap",
    [("nnaa", (0.1, 0.7, 0.8, 0.4), 0.75, 5 / 6), ("nnaa", (1.0, 0.1, 0.8, 0.7), 0.5, 7 / 12), ("nnaa", (0.5,) * 4, 0.5, 0.5)]
)
def test_ranking_values(spark, labels, scores, auroc, ap):
    got = ev.ranking_quality(revealed(spark, labels, scores)).first()
    assert math.isclose(got["auroc"], auroc) and math.isclose(got["average_precision"], ap)


def test_one_class_has_no_metrics(spark):
    shown = revealed(spark, "nnn", (0.1, 0.2, 0.9))
    assert ev.confusion(shown).first()["metrics_status"] == "METRICS_CLASS_SUPPORT_INVALID"
    assert ev.ranking_quality(shown).first()["auroc"] is None


def test_strict_threshold_and_failed_rows(spark):
    rows = score_rows(spark, [(0.5, "ok", None), (0.5, "failed", "X"), (0.6, "ok", None)])
    got = sc.classify(rows, spark.createDataFrame([("m", 0.5)], "method string, threshold double")).orderBy("item").collect()
    assert [r["predicted_class"] for r in got] == ["normal", "anomaly", "anomaly"]
    assert [r["decision_reason"] for r in got] == ["within_threshold", "score_failed", "above_threshold"]


def test_nan_and_missing_scores_fail(spark):
    rules = spark.createDataFrame([("m", 0.0, 1.0, True, 1.0)], "method string, low double, high double, inclusive boolean, failure_score double")
    rows = spark.createDataFrame(
        [
            ("m", 1, "ok", None, float("nan")),
            ("m", 2, "ok", None, None),
            ("m", 3, "ok", None, float("inf")),
            ("m", 4, "failed", "C", 0.3),
            ("m", 5, "ok", None, 0.2)
        ],
        "method string, item long, score_status string, failure_code string, score double"
    )
    got = sc.with_failures(rows, rules).orderBy("item").collect()
    assert [
        (r["score_status"], r["failure_code"], r["score"]) for r in got
    ] == [("failed", "SCORE_INVALID", 1.0)] * 3 + [("failed", "C", 1.0), ("ok", None, 0.2)]
    assert sc.state_violations(sc.with_failures(rows, rules), rules).isEmpty()


@pytest.mark.parametrize(
    "row,rule",
    [
        ((2.0, "ok", None), "score_out_of_range"),
        ((0.5, "ok", "X"), "code_without_failure"),
        ((1.0, "failed", None), "failure_without_code"),
        ((0.5, "failed", "X"), "wrong_failure_score"),
        ((0.5, "odd", None), "unknown_status"),
        ((float("nan"), "ok", None), "score_not_finite")
    ]
)
def test_each_state_rule_fires(spark, row, rule):
    rules = spark.createDataFrame([("m", 0.0, 1.0, True, 1.0)], "method string, low double, high double, inclusive boolean, failure_score double")
    assert [r["rule"] for r in sc.state_violations(score_rows(spark, [row]), rules).collect()] == [rule]


@pytest.mark.parametrize(
    "labels,code",
    [
        ([], "LABELS_EMPTY"),
        ([(0, "normal"), (0, "normal"), (1, "anomaly")], "LABELS_DUPLICATE"),
        ([(0, "normal")], "LABELS_MISSING"),
        ([(0, "normal"), (1, "anomaly"), (2, "anomaly")], "LABELS_EXTRA"),
        ([(0, "odd"), (1, "anomaly")], "LABELS_INVALID"),
        ([(0, "normal"), (1, "anomaly")], "ok")
    ]
)
def test_reveal_codes(spark, labels, code):
    items = spark.range(2).withColumnRenamed("id", "item")
    assert ev.reveal_status(items, spark.createDataFrame(labels, "item long, true_class string")).first()["status_code"] == code


def test_gate_boundaries_pass_and_order_stops_at_first_failure(spark):
    facts = spark.createDataFrame(
        [("m", 0.05, 0.90, 1.0, 20.0, 0.0, 1.0), ("n", 0.05, 0.90, 1.5, 21.0, 0.0, 1.0)],
        "method string, fpr double, recall double, p95_duration double, reference_count double, anomaly_training_labels double, reproduced double"
    )
    gated = ev.gates(facts)
    assert gated.where("method = 'm' and not passed").isEmpty()
    states = [r["gate_status"] for r in ev.short_circuit(gated).where("method = 'n'").orderBy("gate_order").collect()]
    assert states == ["pass", "pass", "fail", "not_evaluated", "not_evaluated", "not_evaluated"]


def test_selection_and_hmac(spark):
    rows = spark.createDataFrame([("a", f"p{i}") for i in range(50)], "category string, path string")
    got = partition.seeded_partitions(rows, "ns", 7, 5, "category", "path").orderBy("selection_rank").collect()
    want = sorted((hashlib.sha256(f"ns:7:p{i}".encode()).hexdigest(), f"p{i}") for i in range(50))
    assert [(r["selection_sha256"], r["path"]) for r in got] == want
    assert [r["partition"] for r in got] == ["reference"] * 5 + ["calibration"] * 45
    key = bytes(range(40))
    found = rows.select("path", S.hmac_sha256(key, F.col("path")).alias("h")).collect()
    assert all(r["h"] == hmac.digest(key, r["path"].encode(), "sha256").hex() for r in found)
    with pytest.raises(ValueError):
        partition.opaque_order(rows, b"short", "path")
    with pytest.raises(ValueError):
        partition.split_labels(rows, key, "path", "category", ["category"])


@pytest.mark.parametrize(
    "path,safe",
    [
        ("", False), ("/absolute.JPG", False), ("../parent.JPG", False), ("a/../b.JPG", False), ("windows\\path.JPG", False),
        (None, False), ("a/b.JPG", True)
    ]
)
def test_paths(spark, path, safe):
    assert spark.createDataFrame([(path,)], "p string").select(S.safe_relative_path(F.col("p"))).first()[0] is safe


@pytest.mark.parametrize("n,fraction,rounding,k", [(256, 0.01, "floor", 2), (225, 0.05, "ceil", 12), (10, 0.01, "floor", 1)])
def test_top_fraction(spark, n, fraction, rounding, k):
    assert spark.range(1).select(S.top_fraction_count(F.lit(n), fraction, rounding)).first()[0] == k


def test_repeat_tolerance_keeps_mismatches(spark):
    a = score_rows(spark, [(0.1, "ok", None), (0.2, "ok", None), (1.0, "failed", "X")])
    b = score_rows(spark, [(0.1 + 1e-6 / 2, "ok", None), (0.3, "ok", None), (1.0, "failed", "Y")])
    assert [r["within_tolerance"] for r in reproduce.compared(a, b, ["method", "item"]).orderBy("item").collect()] == [True, False, False]


def test_label_leak_is_refused_before_reading(spark):
    with pytest.raises(contracts.ContractError):
        vectors.nearest_distances(
            spark.createDataFrame([(1, 0, [1.0], 0)], "vec_id long, position int, patch array<double>, label int"),
            "vec_id",
            spark.createDataFrame([([1.0],)], "patch array<double>")
        )


def test_large_banks_give_the_same_distances(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    q = spark.createDataFrame([(i, p, rng.normal(size=4).tolist()) for i in range(12) for p in range(2)], "vec_id long, position int, patch array<double>")
    bank = vectors.bank(spark.createDataFrame([(rng.normal(size=4).tolist(),) for _ in range(50)] + [([0.0] * 4,)], "patch array<double>"))
    small = {(r["vec_id"], r["position"]): r["distance"] for r in vectors.nearest_distances(q, "vec_id", bank).collect()}
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    large = {(r["vec_id"], r["position"]): r["distance"] for r in vectors.nearest_distances(q, "vec_id", bank).collect()}
    assert small.keys() == large.keys() and all(abs(small[k] - large[k]) < 1e-12 for k in small)


def test_template_support(spark):
    ref = spark.createDataFrame([([1.0, None, 3.0],), ([3.0, 2.0, 3.0],), ([2.0, 2.0, 9.0],)], "v array<double>")
    t = vectors.median_template(ref, "v")
    rows = {r["dim"]: r for r in t.collect()}
    assert [rows[i]["median"] for i in range(3)] == [2.0, 2.0, 3.0] and not rows[1]["supported"] and not rows[1]["template_ok"]
    out = vectors.template_residuals(spark.createDataFrame([(1, [2.0, 50.0, 4.0]), (2, [None, 1.0, 4.0])], "id long, v array<double>"), "id", "v", t, 0.5)
    assert [(r["score_status"], r["score"]) for r in out.orderBy("id").collect()] == [("ok", 1.0), ("failed", None)]


def test_contract_rules_fire(spark):
    rows = spark.createDataFrame([("a", 5.0, "x"), ("b", None, "y"), ("c", 0.5, "z")], "k string, v double, t string")
    got = contracts.row_violations(rows, [contracts.Field("v", low=1.0, high=4.0), contracts.Field("t", values=("x", "y"), pattern="^[xz]$")], "k")
    assert {(r["rule"], r["row_key"]) for r in got.collect()} == {
        ("v:above_maximum", "a"), ("v:null", "b"), ("v:below_minimum", "c"), ("t:not_allowed", "c"), ("t:malformed", "b")
    }


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = inventory.closure(spark.createDataFrame([("a",)], "node string"), e)
    assert {(r["node"], r["depth"]) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_damaged_state_is_refused(spark, tmp_path):
    from scoregate.sources import bundles

    path = f"file://{tmp_path}/state"
    digest = bundles.save_state(spark.createDataFrame([("m", 1.0)], "method string, threshold double"), path)
    assert bundles.load_state(spark, path, digest).count() == 1
    with pytest.raises(ValueError):
        bundles.load_state(spark, path, "0" * 64)


def test_csv_header_and_nulls(spark, tmp_path):
    from scoregate.sources import files

    df = spark.createDataFrame([(1, None, True, '{"a": "b, \\"c\\""}'), (2, "x", False, "{}")], "k long, s string, b boolean, j string")
    files.write_csv(df, f"file://{tmp_path}/t", ["k"])
    assert files.read_csv(spark, f"file://{tmp_path}/t", df.schema).orderBy("k").collect() == df.orderBy("k").collect()
    other = spark.createDataFrame([], "z long, s string, b boolean, j string").schema
    with pytest.raises(Exception):
        files.read_csv(spark, f"file://{tmp_path}/t", other).collect()


def test_files_as_bytes(spark, tmp_path):
    from scoregate.sources import files

    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "d" / "x.bin").write_bytes(b"abc")
    (tmp_path / "in" / "y.bin").write_bytes(b"z")
    assets = files.read_bytes(spark, f"file://{tmp_path}/in")
    manifest = spark.createDataFrame(
        [("d/x.bin", 3, hashlib.sha256(b"abc").hexdigest()), ("y.bin", 1, hashlib.sha256(b"").hexdigest()), ("gone", 1, "0")],
        "asset string, byte_count long, sha256 string"
    )
    got = {r["asset"]: r["verification"] for r in files.verify_bytes(assets, manifest, "asset", "content").collect()}
    assert got == {"d/x.bin": "verified", "y.bin": "changed", "gone": "absent"}

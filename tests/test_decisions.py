"""Decisions, the checks of what the library's own operators give, and null keys."""

import pytest
from pyspark.sql import functions as F

from scoregate.operators import contracts as c, evaluation as ev, inventory as inv, reproduce, scores as sc

EVIDENCE = "method string, leakage boolean, contradicted boolean, guardrail boolean, condition string, rationale string"


def gated(spark, methods, failing=()):
    rows = [(m, 1, "normal_fpr", m not in failing) for m in methods]
    return spark.createDataFrame(rows, "method string, gate_order int, gate string, passed boolean")


CASES = {
    "adopted": ((False, False, False, None, "read"), "ADOPT", "all_passed", True),
    "conditional": ((False, False, True, "watch drift", "read"), "ADOPT WITH CONDITIONS", "guardrail", True),
    "no_condition": ((False, False, True, None, "read"), "REJECT", "evidence_invalid", False),
    "unasked_condition": ((False, False, False, "watch", "read"), "REJECT", "evidence_invalid", False),
    "unknown_guardrail": ((False, False, None, None, "read"), "REJECT", "evidence_invalid", False),
    "unknown_leakage": ((None, False, False, None, "read"), "REJECT", "evidence_invalid", False),
    "untrimmed": ((False, False, True, " watch", "read"), "REJECT", "evidence_invalid", False),
    "long": ((False, False, True, "x" * 501, "read"), "REJECT", "evidence_invalid", False),
    "no_rationale": ((False, False, False, None, None), "REJECT", "evidence_invalid", False),
    "leaky": ((True, False, False, None, "read"), "REJECT", "leakage", True),
    "disputed": ((False, True, True, "watch", "read"), "REJECT", "contradicted", True),
    "failing": ((False, False, True, "watch", "read"), "REJECT", "gate_failed", True),
}


def test_every_reason_for_a_decision(spark):
    g = gated(spark, [*CASES, "silent"], ("failing",))
    decided = ev.decide(g, spark.createDataFrame([(m, *e) for m, (e, *_) in CASES.items()], EVIDENCE))
    got = {r["method"]: r for r in decided.collect()}
    for m, (evidence, decision, reason, valid) in CASES.items():
        r = got[m]
        assert (r["decision"], r["decision_reason"], r["evidence_valid"]) == (decision, reason, valid), m
        assert r["condition"] == (evidence[3] if decision == "ADOPT WITH CONDITIONS" else None)
    assert (got["silent"]["decision"], got["silent"]["decision_reason"]) == ("REJECT", "evidence_invalid")
    assert c.decision_violations(decided, ev.short_circuit(g)).collect() == []
    turned = decided.withColumn("decision", F.when(F.col("decision") == "REJECT", "ADOPT").otherwise("REJECT"))
    found = {r["method"] for r in c.decision_violations(turned, ev.short_circuit(g)).where("rule = 'decision'").collect()}
    assert found == {*CASES, "silent"}


def test_closed_failures_break_no_rule(spark):
    rows = [("m", 1, "ok", 1.0), ("m", 2, "ok", None), ("m", 3, "failed", 9.0), ("m", 4, None, 0.0), ("x", 5, "ok", 0.5), (None, 6, "ok", 0.5)]
    classed = sc.classify(
        spark.createDataFrame(rows, "method string, item int, score_status string, score double"),
        spark.createDataFrame([("m", 0.5)], "method string, threshold double")
    )
    assert {r["decision_reason"] for r in classed.collect()} >= {"threshold_missing", "score_missing", "above_threshold", "score_failed"}
    assert c.semantic_violations(classed).collect() == []


def test_moved_pairs_break_no_rule(spark):
    schema = "method string, item int, score_status string, failure_code string, score double, place int"
    a = spark.createDataFrame([("m", 1, "ok", None, 1.0, 1), ("m", 2, "ok", None, 1.0, 2), ("m", 3, "ok", None, 1.0, 3)], schema)
    compared = reproduce.compared(a.where("item <> 3"), a.where("item <> 1").withColumn("place", F.lit(9)), ["method", "item"], order="place")
    assert {r["pair_state"] for r in compared.collect()} == {"absent", "extra", "moved"}
    assert c.reproduction_violations(compared).collect() == []


def test_decision_from_facts(spark):
    truth = spark.createDataFrame([(i, "anomaly" if i % 5 == 0 else "normal") for i in range(100)], "item int, true_class string")
    scored = truth.select(
        F.lit("m").alias("method"),
        "item",
        F.lit("ok").alias("score_status"),
        F.lit(None).cast("string").alias("failure_code"),
        F.when(F.col("true_class") == "anomaly", 2.0).otherwise(0.1).alias("score")
    )
    calibration = scored.where("score < 1").withColumn("score", F.col("item") / 100)
    facts = spark.createDataFrame(
        [("m", 0.5, 20.0, 0.0, 1.0)],
        "method string, p95_duration double, reference_count double, anomaly_training_labels double, reproduced double"
    )
    decision = lambda **more: reproduce.evaluation_tables(calibration, scored, truth, **more)["decision"].first()["decision"]
    assert decision(facts=facts) == "ADOPT"
    assert decision() == decision(facts=facts.withColumn("p95_duration", F.lit(1.5))) == decision(facts=facts.where("false")) == "REJECT"


def test_null_keys_are_keys(spark):
    a = spark.createDataFrame([(None,), (1,)], "item int")
    assert ev.coverage(a, a).collect() == []
    edges = spark.createDataFrame([(1, None), (None, 2), (2, None), (2, 1)], "src int, dst int")
    got = sorted(((r["node"], r["depth"]) for r in inv.closure(spark.createDataFrame([(1,)], "node int"), edges).collect()), key=str)
    assert got == sorted([(1, 0), (None, 1), (2, 2)], key=str)


@pytest.mark.parametrize(
    "names,clash",
    [
        (("STRASSE", "straße"), True),
        (("σοφός", "ΣΟΦΌΣ", "σοφόσ"), True),
        (("a", "A"), True),
        (("é", "e"), False),
        (("ab", "a b"), False)
    ]
)
def test_case_clashes(spark, names, clash):
    got = inv.case_clashes(spark.createDataFrame([(n,) for n in (*names, None, "other")], "name string"), "name").collect()
    assert [r["name_count"] for r in got] == ([len(names)] if clash else [])


def test_helper_columns_leave_names_alone(spark):
    shown = spark.createDataFrame(
        [("m", 1, "normal", True, 1.0, "own", "own")],
        "method string, item int, true_class string, is_anomalous boolean, score double, _signed string, _rank string"
    )
    [r] = ev.error_cases(shown).collect()
    assert (r["_signed"], r["_rank"]) == ("own", "own")


def test_a_null_score_has_no_rank(spark):
    shown = spark.createDataFrame(
        [("m", "anomaly", 2.0), ("m", "normal", 1.0), ("n", "anomaly", 2.0), ("n", "normal", None)],
        "method string, true_class string, score double"
    )
    assert {r["method"]: r["auroc"] for r in ev.ranking_quality(shown).collect()} == {"m": 1.0, "n": None}


def test_folding_is_unicodes(spark):
    from scoregate.functions import scalars as S

    texts = [chr(i) + "aA" for i in (*range(1, 0xD800), *range(0xE000, 0x1F000))]
    got = {r["t"]: r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.folded(F.col("t")).alias("f")).collect()}
    # characters younger than the JVM's tables may fold differently, of which there are few
    assert sum(got[t] != t.casefold() for t in texts) < 60
    assert got["ﬃaA"] == "ffiaa" and got["ẞaA"] == "ssaa"

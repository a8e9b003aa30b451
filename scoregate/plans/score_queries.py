"""Queries over score tables: failure substitution to the decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoregate.operators import contracts, evaluation as ev, partition, reproduce, scores as sc
from scoregate.plans import inputs as I
from scoregate.plans.registry import query
from scoregate.sources.stages import staged


@query("failure_substitution", f"WITH {I.SCORES_SQL} SELECT method, item, score_status, failure_code, score FROM scores")
def failure_substitution(spark, sf_dir):
    return I.scores(spark, sf_dir)


@query("score_state_violations", f"""WITH {I.RULES_SQL}, {I.RAW_SQL}, s AS (
  SELECT method, item, score_status, failure_code, score * 1.25::DOUBLE AS score FROM raw WHERE score IS NOT NULL)
SELECT method, item, 'score_out_of_range' AS rule FROM s JOIN rules USING (method) WHERE NOT CASE
    WHEN inclusive THEN score BETWEEN low AND high ELSE score > low AND score < high END""")
def score_state_violations(spark, sf_dir):
    """Scores a quarter too large: those out of their method's range are reported."""
    raw = I.raw_scores(spark, sf_dir).where("score is not null").withColumn("score", F.col("score") * F.lit(1.25))
    return sc.state_violations(raw, I.rules(spark))


@query("calibration_threshold", f"WITH {I.CALIBRATION_SQL} SELECT * FROM cuts")
def calibration_threshold(spark, sf_dir):
    return sc.thresholds(I.calibration(spark, sf_dir))


@query("calibration_threshold_quantiles", f"""WITH {I.CALIBRATION_SQL}, q(quantile) AS (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE))
SELECT method, quantile, n AS item_count, r AS threshold_rank, score AS threshold, item AS threshold_item FROM ranked, q
    WHERE r = ceil(quantile * n::DOUBLE)""")
def calibration_threshold_quantiles(spark, sf_dir):
    rows = I.calibration(spark, sf_dir)
    out = None
    for q in (0.5, 0.9, 0.99):
        one = sc.thresholds(rows, q).withColumn("quantile", F.lit(q))
        out = one if out is None else out.unionByName(one)
    return out


@query("realized_calibration_rate", f"""WITH {I.CALIBRATION_SQL}
SELECT c.method, count(*) AS item_count, count(*) FILTER (WHERE score_status = 'failed'
    OR score > threshold) AS above_count, round(count(*) FILTER (WHERE score_status = 'failed' OR score > threshold) / count(*), 9) AS realized_rate
FROM calibration c JOIN cuts ON c.method = cuts.method GROUP BY c.method""")
def realized_calibration_rate(spark, sf_dir):
    rows = I.calibration(spark, sf_dir)
    return sc.realized_rate(sc.classify(rows, sc.thresholds(rows))).withColumn("realized_rate", F.round("realized_rate", 9))


@query("fixed_threshold_classification", f"WITH {I.CLASSIFIED_SQL} SELECT * FROM classified")
def fixed_threshold_classification(spark, sf_dir):
    return I.classified(spark, sf_dir)


@query("batch_class_counts", f"""WITH {I.CLASSIFIED_SQL} SELECT method, count(*) AS item_count,
    count(*) FILTER (WHERE NOT is_anomalous) AS normal_count, count(*) FILTER (WHERE is_anomalous) AS anomalous_count,
  count(*) FILTER (WHERE score_status = 'failed') AS failed_count, true AS sums_agree FROM classified GROUP BY method""")
def batch_class_counts(spark, sf_dir):
    return sc.class_counts(I.classified(spark, sf_dir))


@query("fit_summary", f"""WITH {I.SCORES_SQL} SELECT method, count(*) FILTER (WHERE score_status = 'ok') AS success_count,
    count(*) FILTER (WHERE score_status = 'failed') AS failure_count,
  CASE WHEN count(*) FILTER (WHERE score_status = 'ok') < 16 THEN 'fit_failed' ELSE 'ok' END AS fit_status FROM scores GROUP BY method""")
def fit_summary(spark, sf_dir):
    return sc.fit_summary(I.scores(spark, sf_dir), 16)


@query("exact_id_reveal", f"WITH {I.CLASSIFIED_SQL} SELECT method, item, is_anomalous, score, true_class FROM revealed")
def exact_id_reveal(spark, sf_dir):
    return I.revealed(spark, sf_dir).select("method", "item", "is_anomalous", "score", "true_class")


@query("reveal_status", f"""WITH {I.LABELS_SQL}, cases AS (
  SELECT 'complete' AS reveal_case, doc_id AS item FROM documents WHERE doc_id IN (SELECT item FROM truth) UNION ALL
  SELECT 'all_documents', doc_id FROM documents UNION ALL
  SELECT 'fewer_items', doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id IN (SELECT item FROM truth) UNION ALL
  SELECT 'moved', doc_id FROM documents WHERE doc_id IN (SELECT item FROM truth) UNION ALL
  SELECT 'repeated', doc_id FROM documents WHERE doc_id IN (SELECT item FROM truth) UNION ALL SELECT 'repeated', doc_id
    FROM documents WHERE doc_id % 5 = 0 AND doc_id IN (SELECT item FROM truth)),
kinds AS (SELECT DISTINCT reveal_case FROM cases),
a AS (SELECT reveal_case, item, count(*) AS i FROM cases GROUP BY ALL), l AS (SELECT reveal_case, item, 1 AS b FROM truth, kinds),
j AS (SELECT reveal_case, item, i, b FROM a FULL JOIN l USING (reveal_case, item)),
n AS (SELECT reveal_case, coalesce(sum(b), 0)::BIGINT AS label_count, 0::BIGINT AS invalid_count, 0::BIGINT AS duplicate_count,
    count(*) FILTER (WHERE i > 1) AS item_duplicate_count,
  count(*) FILTER (WHERE b IS NULL) AS missing_count, count(*) FILTER (WHERE i IS NULL) AS extra_count,
    count(*) FILTER (WHERE reveal_case = 'moved' AND item % 7 = 0 AND i IS NOT NULL AND b IS NOT NULL) AS moved_count FROM j GROUP BY reveal_case)
SELECT *, CASE WHEN item_duplicate_count > 0 THEN 'ITEMS_DUPLICATE' WHEN missing_count > 0 THEN 'LABELS_MISSING'
    WHEN extra_count > 0 THEN 'LABELS_EXTRA' WHEN moved_count > 0 THEN 'LABELS_MISORDERED' ELSE 'ok' END AS status_code FROM n""")
def reveal_status(spark, sf_dir):
    """A complete join, and joins that miss, repeat or move items."""
    labels = I.labels(spark, sf_dir).withColumn("place", F.col("item"))
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("doc_id").alias("place"))
    known = docs.join(labels, "item", "left_semi")
    moved = known.withColumn("place", F.when(F.col("item") % 7 == 0, -1).otherwise(F.col("place")))
    cases = (
        ("complete", known),
        ("all_documents", docs),
        ("fewer_items", known.where("item % 2 = 0")),
        ("moved", moved),
        ("repeated", known.unionByName(known.where("item % 5 = 0")))
    )
    out = None
    for name, items in cases:
        one = ev.reveal_status(items, labels, order="place").withColumn("reveal_case", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "label_coverage",
    f"WITH {I.LABELS_SQL}, s AS (SELECT DISTINCT doc_id AS item FROM documents) SELECT item, 'unlabelled' AS side FROM s "
    f"WHERE item NOT IN (SELECT item FROM truth) UNION ALL SELECT item, 'unscored' FROM truth WHERE item NOT IN (SELECT item FROM s)"
)
def label_coverage(spark, sf_dir):
    return ev.coverage(I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item")), I.labels(spark, sf_dir))


CONFUSION_SQL = f"""{I.CLASSIFIED_SQL}, confusion AS (
  SELECT method, count(*) FILTER (WHERE true_class = 'anomaly' AND is_anomalous) AS true_positive,
    count(*) FILTER (WHERE true_class = 'anomaly' AND NOT is_anomalous) AS false_negative,
    count(*) FILTER (WHERE true_class = 'normal' AND NOT is_anomalous) AS true_negative,
    count(*) FILTER (WHERE true_class = 'normal' AND is_anomalous) AS false_positive, count(*) FILTER (WHERE score_status = 'failed') AS score_failures
  FROM revealed GROUP BY method),
metrics AS (SELECT *, round(false_positive / (false_positive + true_negative), 9) AS fpr,
    round(true_positive / (true_positive + false_negative), 9) AS recall, 'ok' AS metrics_status FROM confusion)"""


@query("confusion_metrics", f"WITH {CONFUSION_SQL} SELECT * FROM metrics")
def confusion_metrics(spark, sf_dir):
    return ev.confusion(I.revealed(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("fpr", "recall")})


RANKING_SQL = f"""{I.CLASSIFIED_SQL}, steps AS (SELECT method, score, count(*) FILTER (WHERE true_class = 'anomaly') AS pos,
    count(*) FILTER (WHERE true_class = 'normal') AS neg FROM revealed GROUP BY method, score),
cum AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM steps WINDOW w AS (PARTITION BY method ORDER BY score DESC)),
ranking AS (SELECT method, round(sum(neg * (cp - pos / 2))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE, 9) AS auroc,
    round(sum(pos * cp / (cp + cn)) / sum(pos), 9) AS average_precision FROM cum GROUP BY method)"""


@query("ranking_metrics", f"WITH {RANKING_SQL} SELECT * FROM ranking")
def ranking_metrics(spark, sf_dir):
    return ev.ranking_quality(I.revealed(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("auroc", "average_precision")})


@query("error_cases", f"""WITH {I.CLASSIFIED_SQL}, c AS (SELECT *, CASE WHEN true_class = 'normal'
    AND is_anomalous THEN 'false_positive' WHEN true_class = 'anomaly' AND NOT is_anomalous THEN 'false_negative' END AS case_type FROM revealed),
r AS (SELECT method, case_type, item, score, score_margin, row_number() OVER (PARTITION BY method, case_type ORDER BY CASE
    WHEN case_type = 'false_positive' THEN -score ELSE score END, item) AS case_rank FROM c WHERE case_type IS NOT NULL)
SELECT * FROM r WHERE case_rank <= 5""")
def error_cases(spark, sf_dir):
    return ev.error_cases(I.revealed(spark, sf_dir)).select("method", "case_type", "item", "score", "score_margin", "case_rank")


LATENCY_SQL = f"""{I.OBSERVATIONS_SQL}, latency AS (SELECT method, count(*) AS observation_count,
    count(*) FILTER (WHERE score_status = 'failed') AS failed_count, count(DISTINCT CASE WHEN score_status = 'failed' THEN item END) AS failed_items,
  round(median(duration), 9) AS median_duration, quantile_disc(duration, 0.95) AS p95_duration,
    ceil(0.95::DOUBLE * count(*))::BIGINT AS p95_rank, min(duration) AS min_duration, max(duration) AS max_duration FROM observations GROUP BY method)"""


@query("latency_summary", f"WITH {LATENCY_SQL} SELECT * FROM latency")
def latency_summary(spark, sf_dir):
    return ev.latency(I.observations(spark, sf_dir), ["method"]).withColumn("median_duration", F.round("median_duration", 9))


@query("latency_completeness", f"""WITH {I.OBSERVATIONS_SQL}, s AS (SELECT method, pass_index, count(*) AS observation_count,
    count(*) FILTER (WHERE score_status = 'failed') AS failed_count, quantile_disc(duration, 0.95) AS p95_duration FROM observations GROUP BY ALL),
e AS (SELECT method, count(DISTINCT item) AS expected FROM observations GROUP BY method)
SELECT s.method, pass_index, observation_count, failed_count, observation_count = expected
    AND failed_count = 0 AS is_complete, CASE WHEN observation_count = expected
    AND failed_count = 0 THEN p95_duration END AS complete_p95 FROM s JOIN e ON s.method = e.method""")
def latency_completeness(spark, sf_dir):
    """p95 of each pass only where it observed every item of its method without a failure."""
    obs = I.observations(spark, sf_dir)
    items = obs.groupBy("method").agg(F.count_distinct("item").alias("expected"))
    out = ev.latency(obs.join(F.broadcast(items), "method"), ["method", "pass_index", "expected"], F.col("expected"))
    return out.select("method", F.col("pass_index").cast("long").alias("pass_index"), "observation_count", "failed_count", "is_complete", "complete_p95")


@query(
    "latency_pass_contiguity",
    f"WITH {I.OBSERVATIONS_SQL} SELECT method, item, count(*) AS row_count, "
    f"min(pass_index) = 0 AND max(pass_index) = count(*) - 1 AND count(DISTINCT pass_index) = count(*) AS contiguous FROM observations GROUP BY ALL"
)
def latency_pass_contiguity(spark, sf_dir):
    return contracts.contiguity(I.observations(spark, sf_dir), ["method", "item"], "pass_index")


@query("derived_durations", f"""WITH {I.OBSERVATIONS_SQL} SELECT event_id, method, CASE WHEN method = 'click'
    AND adapter IS NOT NULL THEN adapter + duration WHEN method <> 'click' AND adapter IS NULL THEN duration END AS total_duration,
  (method = 'click') = (adapter IS NULL) AS times_contradict
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN duration / 4 END AS adapter FROM observations)""")
def derived_durations(spark, sf_dir):
    """Adapter and scorer time add up for the one method that has an adapter; elsewhere an adapter time is an error."""
    o = I.observations(spark, sf_dir).withColumn("adapter", F.when(F.col("event_id") % 3 == 0, F.col("duration") / 4))
    total, wrong = sc.total_duration(F.col("method"), F.col("adapter"), F.col("duration"), ("click",))
    return o.select("event_id", "method", total.alias("total_duration"), wrong.alias("times_contradict"))


FACTS_SQL = f"""{CONFUSION_SQL}, {LATENCY_SQL.replace('latency AS', 'latency_by_event AS')},
p95 AS (SELECT quantile_disc(duration, 0.95) AS p95_duration, round(median(duration), 9) AS median_duration FROM observations),
refs AS (SELECT item FROM calibration GROUP BY item ORDER BY sha256('scoregate:42:' || item), item LIMIT 20),
trained AS (SELECT count(*)::DOUBLE AS reference_count, (count(*) FILTER (WHERE item IN (SELECT item FROM truth
    WHERE true_class = 'anomaly')))::DOUBLE AS anomaly_training_labels FROM refs),
again AS (SELECT method, CASE WHEN bool_or(method = 'template_residual' AND item % 50 = 3) THEN 0.0
    ELSE 1.0 END::DOUBLE AS reproduced FROM final_test GROUP BY method),
facts AS (SELECT method, fpr, recall, p95_duration, median_duration, reference_count, anomaly_training_labels, reproduced
    FROM metrics JOIN again USING (method), p95, trained),
gates AS (SELECT method, g.gate_order, g.gate, g.comparison, g.gate_limit, CASE g.gate_order WHEN 1 THEN fpr WHEN 2 THEN recall
    WHEN 3 THEN p95_duration WHEN 4 THEN reference_count WHEN 5 THEN anomaly_training_labels ELSE reproduced END AS measured
  FROM facts, (VALUES (1, 'normal_fpr', '<=', 0.05::DOUBLE), (2, 'anomaly_recall', '>=', 0.9::DOUBLE), (3, 'cpu_p95', '<=',
    1.0::DOUBLE), (4, 'normal_references', '<=', 20.0::DOUBLE), (5, 'no_anomaly_training', '<=', 0.0::DOUBLE), (6, 'reproducible',
    '>=', 1.0::DOUBLE)) g(gate_order, gate, comparison, gate_limit)),
gated AS (SELECT *, CASE WHEN comparison = '<=' THEN measured <= gate_limit ELSE measured >= gate_limit END AS passed FROM gates)"""


def facts(spark, sf_dir):
    """What the gates measure, a row for each method."""
    overall = ev.latency(I.observations(spark, sf_dir).withColumn("all", F.lit(1)), ["all"]).select(
        "p95_duration", F.round("median_duration", 9).alias("median_duration")
    )
    cal, fin = staged(I.calibration(spark, sf_dir)), staged(I.final_test(spark, sf_dir))
    shown = ev.reveal(sc.classify(fin, sc.thresholds(cal)), I.labels(spark, sf_dir))
    m = ev.confusion(shown).select("method", *(F.round(c, 9).alias(c) for c in ("fpr", "recall")))
    references = partition.first_by_digest(cal.select("item").distinct(), I.NAMESPACE, I.SEED, "item", 20)
    truth = I.labels(spark, sf_dir).select("item", (F.col("true_class") == "anomaly").alias("anomaly"))
    trained = references.join(truth, "item", "left").agg(
        F.count(F.lit(1)).cast("double").alias("reference_count"),
        F.count_if("anomaly").cast("double").alias("anomaly_training_labels")
    )
    # The second scoring run differs in some items of one method.
    off = (F.col("method") == "template_residual") & (F.col("item") % 50 == 3)
    repeated = reproduce.reproduction_summary(
        reproduce.compared(
            fin, fin.withColumn("score", F.when(off, F.col("score") + 0.5).otherwise(F.col("score"))), ["method", "item"]
        )
    )
    repeated = repeated.select("method", F.col("reproduced").cast("double").alias("reproduced"))
    return staged(m.join(repeated, "method").join(F.broadcast(overall), F.lit(True)).join(F.broadcast(trained), F.lit(True)))


@query("hard_gates", f"WITH {FACTS_SQL} SELECT method, gate_order, gate, measured, comparison, gate_limit, passed FROM gated")
def hard_gates(spark, sf_dir):
    return ev.gates(facts(spark, sf_dir))


@query("ordered_gates", f"""WITH {FACTS_SQL}, f AS (SELECT *, min(CASE
    WHEN NOT passed THEN gate_order END) OVER (PARTITION BY method) AS first_failed_order FROM gated)
SELECT method, gate_order, gate, passed, first_failed_order, CASE WHEN first_failed_order IS NULL
    OR gate_order < first_failed_order THEN 'pass' WHEN gate_order = first_failed_order THEN 'fail' ELSE 'not_evaluated' END AS gate_status FROM f""")
def ordered_gates(spark, sf_dir):
    return ev.short_circuit(ev.gates(facts(spark, sf_dir))).select("method", "gate_order", "gate", "passed", "first_failed_order", "gate_status")


DECISION_SQL = f"""{FACTS_SQL}, evidence(method, leakage, contradicted, guardrail, condition) AS (VALUES ('bank_nn', false, false,
    false, NULL), ('position_zscore', false, false, true, 'watch drift'), ('template_residual', false, true, false, NULL)),
summary AS (SELECT method, bool_and(passed) AS all_passed, first(gate
    ORDER BY gate_order) FILTER (WHERE NOT passed) AS first_failed_gate FROM gated GROUP BY method),
reasons AS (SELECT s.*, leakage, contradicted, guardrail, condition AS asked, guardrail = (condition IS NOT NULL) AS evidence_valid,
  CASE WHEN guardrail <> (condition IS NOT NULL) THEN 'evidence_invalid' WHEN NOT all_passed THEN 'gate_failed'
    WHEN leakage THEN 'leakage' WHEN contradicted THEN 'contradicted' WHEN guardrail THEN 'guardrail' ELSE 'all_passed' END AS decision_reason
  FROM summary s JOIN evidence USING (method)),
decisions AS (SELECT * EXCLUDE (asked), CASE decision_reason WHEN 'all_passed' THEN 'ADOPT'
    WHEN 'guardrail' THEN 'ADOPT WITH CONDITIONS' ELSE 'REJECT' END AS decision, CASE
    WHEN decision_reason = 'guardrail' THEN asked END AS condition FROM reasons)"""


def decisions(spark, sf_dir, measured=None):
    evidence = spark.createDataFrame(
        [
            ("bank_nn", False, False, False, None),
            ("position_zscore", False, False, True, "watch drift"),
            ("template_residual", False, True, False, None)
        ],
        "method string, leakage boolean, contradicted boolean, guardrail boolean, condition string"
    )
    return ev.decide(ev.gates(measured or facts(spark, sf_dir)), evidence)


@query("method_decision", f"WITH {DECISION_SQL} SELECT * FROM decisions")
def method_decision(spark, sf_dir):
    return decisions(spark, sf_dir)


@query("method_selection", f"""WITH {DECISION_SQL}, c AS (SELECT d.method, decision, recall, fpr, p95_duration, median_duration,
    CASE d.method WHEN 'template_residual' THEN 1 WHEN 'position_zscore' THEN 2 ELSE 3 END AS complexity, CASE decision
    WHEN 'ADOPT' THEN 0 WHEN 'ADOPT WITH CONDITIONS' THEN 1 ELSE 2 END AS k FROM decisions d JOIN facts USING (method)),
p AS (SELECT *, row_number() OVER w AS preference, first(decision) OVER w AS best
    FROM c WINDOW w AS (ORDER BY k, recall DESC, fpr, p95_duration, median_duration, complexity, method))
SELECT method, decision, recall, fpr, preference, CASE WHEN min(k) OVER () = 2 THEN 'REJECT' ELSE best END AS project_decision FROM p""")
def method_selection(spark, sf_dir):
    measured = facts(spark, sf_dir)
    c = decisions(spark, sf_dir, measured).join(measured, "method").withColumn(
        "complexity", ev.complexity(F.col("method"), ["template_residual", "position_zscore", "bank_nn"])
    )
    return ev.select_method(c).select("method", "decision", "recall", "fpr", "preference", "project_decision")


GRADED = (
    ("follows", 1000.0, False, False, False, None),
    ("guarded", 1000.0, False, False, True, "watch drift"),
    ("slow", 100.0, False, False, False, None),
    ("opaque", 1000.0, False, False, True, None),
    ("leaky", 1000.0, True, False, False, None),
    ("disputed", 1000.0, False, True, False, None),
    ("noisy", 1000.0, False, False, False, None)
)
_BOOL = lambda x: str(x).lower()
GRADED_SQL = f"""{I.LABELS_SQL}, m(method, parts, leakage, contradicted, guardrail, asked) AS (VALUES {', '.join(f"('{n}', "
    f"{d}::DOUBLE, {_BOOL(a)}, {_BOOL(b)}, {_BOOL(g)}, {'NULL' if t is None else repr(t)})" for n, d, a, b, g, t in GRADED)}),
cal AS (SELECT doc_id AS item, (doc_id % 100) / 100.0::DOUBLE AS score FROM documents WHERE doc_id NOT IN (SELECT item FROM truth)),
cut AS (SELECT score AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score, item) AS r, count(*) OVER () AS n
    FROM cal) WHERE r = ceil(0.95::DOUBLE * n::DOUBLE)),
fin AS (SELECT method, true_class, CASE WHEN method = 'noisy' THEN (item % 97) / 97.0::DOUBLE
    WHEN true_class = 'anomaly' THEN 2.0::DOUBLE + (item % 7) / 10.0::DOUBLE ELSE (item % 50) / 100.0::DOUBLE END > threshold AS said FROM truth, m, cut),
met AS (SELECT method, count(*) FILTER (WHERE said
    AND true_class = 'normal') / count(*) FILTER (WHERE true_class = 'normal') AS fpr, count(*) FILTER (WHERE said
    AND true_class = 'anomaly') / count(*) FILTER (WHERE true_class = 'anomaly') AS recall FROM fin GROUP BY method),
lat AS (SELECT method, quantile_disc(value / parts, 0.95) AS p95_duration, median(value / parts) AS median_duration FROM events, m GROUP BY method),
failed AS (SELECT *, CASE WHEN fpr > 0.05 THEN 'normal_fpr' WHEN recall < 0.9 THEN 'anomaly_recall'
    WHEN p95_duration > 1.0 THEN 'cpu_p95' END AS first_failed_gate FROM met JOIN lat USING (method) JOIN m USING (method)),
why AS (SELECT *, CASE WHEN guardrail <> (asked IS NOT NULL) THEN 'evidence_invalid'
    WHEN first_failed_gate IS NOT NULL THEN 'gate_failed' WHEN leakage THEN 'leakage' WHEN contradicted THEN 'contradicted'
    WHEN guardrail THEN 'guardrail' ELSE 'all_passed' END AS decision_reason FROM failed),
told AS (SELECT *, CASE decision_reason WHEN 'all_passed' THEN 'ADOPT' WHEN 'guardrail' THEN 'ADOPT WITH CONDITIONS'
    ELSE 'REJECT' END AS decision, CASE WHEN decision_reason = 'guardrail' THEN asked END AS condition, CASE decision_reason
    WHEN 'all_passed' THEN 0 WHEN 'guardrail' THEN 1 ELSE 2 END AS k FROM why),
liked AS (SELECT *, row_number() OVER (ORDER BY k, recall DESC, fpr, p95_duration, median_duration, method) AS preference FROM told)"""


def graded_tables(spark, sf_dir):
    """An evaluation whose methods' scores follow the label, all but one's, with times in seconds: (tables, facts)."""
    m = F.broadcast(spark.createDataFrame([x[:2] for x in GRADED], "method string, parts double"))
    truth, docs = I.labels(spark, sf_dir), I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"))
    ok = lambda df, score: df.join(m, F.lit(True)).select("method", "item", F.lit("ok").alias("score_status"), F.lit(None).cast("string").alias("failure_code"), score.alias("score"))
    k = F.col("item")
    cal = ok(docs.join(truth, "item", "left_anti"), k % 100 / 100.0)
    fin = staged(
        ok(
            truth,
            F.when(F.col("method") == "noisy", k % 97 / 97.0).when(
                F.col("true_class") == "anomaly", 2.0 + k % 7 / 10.0
            ).otherwise(k % 50 / 100.0)
        )
    )
    timed = I.observations(spark, sf_dir).drop("method").join(m, F.lit(True)).withColumn("duration", F.col("duration") / F.col("parts"))
    speed = ev.latency(timed, ["method"]).select("method", "p95_duration", "median_duration")
    again = reproduce.reproduction_summary(reproduce.compared(fin, fin, ["method", "item"])).select(
        "method", F.col("reproduced").cast("double").alias("reproduced")
    )
    facts = staged(speed.join(again, "method").withColumns({"reference_count": F.lit(20.0), "anomaly_training_labels": F.lit(0.0)}))
    evidence = spark.createDataFrame(
        [(x[0], *x[2:]) for x in GRADED],
        "method string, leakage boolean, contradicted boolean, guardrail boolean, condition string"
    )
    return reproduce.evaluation_tables(cal, fin, truth, facts=facts, evidence=evidence), facts


@query(
    "graded_decisions",
    f"WITH {GRADED_SQL} SELECT method, fpr, recall, first_failed_gate, evidence_valid, decision_reason, decision, condition, "
    f"preference, 'ADOPT' AS project_decision FROM (SELECT *, guardrail = (asked IS NOT NULL) AS evidence_valid FROM liked)"
)
def graded_decisions(spark, sf_dir):
    """Methods that are adopted, adopted with a condition, and rejected for each reason there is, with the order of preference."""
    tables, facts = graded_tables(spark, sf_dir)
    candidates = tables["decision"].join(tables["metrics"].select("method", "fpr", "recall"), "method").join(
        facts.select("method", "p95_duration", "median_duration"), "method"
    )
    out = ev.select_method(candidates.withColumn("complexity", F.lit(1).cast("long")))
    return out.select(
        "method", "fpr", "recall", "first_failed_gate", "evidence_valid", "decision_reason", "decision", "condition",
        "preference", "project_decision"
    )


@query("candidate_preference", """WITH t AS (SELECT l_returnflag AS candidate, l_suppkey AS g, sum(l_quantity) > 600 AS passed FROM lineitem GROUP BY ALL)
SELECT g AS supplier, first(candidate ORDER BY CASE candidate WHEN 'N' THEN 1 WHEN 'A' THEN 2
    ELSE 3 END) FILTER (WHERE passed) AS selected FROM t GROUP BY g""")
def candidate_preference(spark, sf_dir):
    t = I.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("candidate"), F.col("l_suppkey").alias("supplier")
    ).agg((F.sum("l_quantity") > 600).alias("passed"))
    return ev.prefer(t, "supplier", ["N", "A", "R"])


@query("metrics_latency_join", f"""WITH {CONFUSION_SQL}, lat AS (SELECT method, count(*) + CASE WHEN method = 'bank_nn' THEN 0
    ELSE 1 END AS timed_items, quantile_disc((item * 7) % 1000, 0.95)::BIGINT AS p95_duration FROM final_test
    WHERE method <> 'template_residual' GROUP BY method)
SELECT m.method, true_positive + false_negative + true_negative + false_positive AS item_count, timed_items, fpr, recall, p95_duration,
  CASE WHEN timed_items IS NULL THEN 'latency_missing'
    WHEN timed_items <> true_positive + false_negative + true_negative + false_positive THEN 'item_count'
    ELSE 'ok' END AS evidence_state FROM metrics m LEFT JOIN lat ON lat.method = m.method""")
def metrics_latency_join(spark, sf_dir):
    """One method's latency covers an item too many, another's is missing."""
    m = confusion_metrics(spark, sf_dir).withColumn("item_count", F.expr("true_positive + false_negative + true_negative + false_positive"))
    fin = I.final_test(spark, sf_dir).where("method <> 'template_residual'").select(
        "method", "item", "score_status", ((F.col("item") * 7) % 1000).alias("duration")
    )
    timed = ev.latency(fin, ["method"]).select(
        "method",
        (F.col("observation_count") + F.when(F.col("method") == "bank_nn", 0).otherwise(1)).alias("item_count"),
        "p95_duration"
    )
    return ev.metrics_with_latency(m, timed).select("method", "item_count", "timed_items", "fpr", "recall", "p95_duration", "evidence_state")


@query(
    "semantic_violations",
    f"""WITH {I.CLASSIFIED_SQL} SELECT method, item, unnest(CASE item % 10 WHEN 0 THEN ['flag', 'class'] WHEN 1 THEN ['margin']
    WHEN 2 THEN ['class'] ELSE ['reason'] END) AS rule FROM classified WHERE item % 10 < 4"""
)
def semantic_violations(spark, sf_dir):
    """Of ten rows one has its flag turned, one its margin moved, one its class turned, one its reason lost."""
    k = F.col("item") % 10
    rows = I.classified(spark, sf_dir).withColumns({
        "score_margin": F.when(k == 1, F.col("score_margin") + 1).otherwise(F.col("score_margin")),
        "predicted_class": F.when(k == 2, F.when(F.col("is_anomalous"), "normal").otherwise("anomaly")).otherwise(F.col("predicted_class")),
        "decision_reason": F.when(k != 3, F.col("decision_reason")),
        "is_anomalous": F.col("is_anomalous") != (k == 0),
    })
    return contracts.semantic_violations(rows)


BROKEN = ("none", "counts", "fpr", "recall", "failures_not_anomalous", "rank")


@query(
    "summary_violations",
    f"WITH {CONFUSION_SQL} SELECT method || ':' || v AS method, v AS rule FROM confusion, (VALUES ('counts'), ('fpr'), "
    f"('recall'), ('failures_not_anomalous'), ('rank')) t(v)"
)
def summary_violations(spark, sf_dir):
    """Each method's summary as it is, and with one fact wrong at a time: each rule is broken once for each method."""
    m = ev.confusion(I.revealed(spark, sf_dir)).withColumn("v", F.explode(F.array(*map(F.lit, BROKEN))))
    n = F.expr("true_positive + false_negative + true_negative + false_positive")
    off = lambda rule, by: F.when(F.col("v") == rule, by).otherwise(F.lit(0))
    return contracts.summary_violations(m.select(
        F.concat("method", F.lit(":"), "v").alias("method"), "true_positive", "false_negative", "true_negative", "false_positive",
        (n + off("counts", 1)).alias("item_count"), (F.col("fpr") + off("fpr", 0.1)).alias("fpr"), (F.col("recall") + off("recall", 0.1)).alias("recall"),
        F.when(F.col("v") == "failures_not_anomalous", F.expr("true_positive + false_positive + 1")).otherwise(F.col("score_failures")).alias("score_failures"),
        n.alias("observation_count"), (F.ceil(F.lit(0.95) * n) + off("rank", 1)).alias("p95_rank"),
    ))


REPRO_SQL = f"""{I.SCORES_SQL}, again AS (SELECT method, CASE WHEN item % 50 = 6 THEN -item
    ELSE item END AS item, score_status, failure_code, CASE WHEN item % 50 = 3 THEN score + 0.5 ELSE score END AS score FROM scores WHERE item % 50 <> 4),
cmp AS (SELECT method, item, s.score_status AS expected_score_status, s.failure_code AS expected_failure_code,
    s.score AS expected_score, a.score_status AS reproduced_score_status, a.failure_code AS reproduced_failure_code, a.score AS reproduced_score,
  CASE WHEN a.score IS NULL THEN 'absent' WHEN s.score IS NULL THEN 'extra'
    ELSE 'compared' END AS pair_state, abs(s.score - a.score) AS absolute_difference, coalesce(abs(s.score - a.score) <= 1e-6, false) AS within_tolerance
  FROM scores s FULL JOIN again a USING (method, item))"""


def _repeat(spark, sf_dir):
    """A second run that misses some items, has others instead, and scores some differently."""
    s = I.scores(spark, sf_dir)
    k = F.col("item") % 50
    again = s.where(k != 4).withColumns(
        {
            "score": F.when(k == 3, F.col("score") + 0.5).otherwise(F.col("score")),
            "item": F.when(k == 6, -F.col("item")).otherwise(F.col("item"))
        }
    )
    return reproduce.compared(s, again, ["method", "item"])


@query("score_reproduction", f"WITH {REPRO_SQL} SELECT * FROM cmp")
def score_reproduction(spark, sf_dir):
    return _repeat(spark, sf_dir)


@query("reproduction_summary", f"""WITH {REPRO_SQL} SELECT method,
    count(*) FILTER (WHERE pair_state = 'compared') AS compared_count,
    count(*) FILTER (WHERE pair_state = 'absent') AS absent_count, count(*) FILTER (WHERE pair_state = 'extra') AS extra_count,
  max(absolute_difference) AS max_difference, bool_and(within_tolerance) AS reproduced FROM cmp GROUP BY method""")
def reproduction_summary(spark, sf_dir):
    return reproduce.reproduction_summary(_repeat(spark, sf_dir))


@query(
    "first_items",
    f"WITH {I.SCORES_SQL}, r AS (SELECT method, item, score, row_number() OVER (PARTITION BY method "
    f"ORDER BY item) AS item_order FROM scores) SELECT * FROM r WHERE item_order <= 10"
)
def first_items(spark, sf_dir):
    return reproduce.first_items(I.scores(spark, sf_dir), 10).select("method", "item", "score", "item_order")


@query("recomputed_tables", f"""WITH {RANKING_SQL}, t AS (SELECT method, 'thresholds' AS table_name FROM cuts UNION ALL
    SELECT method, 'metrics' FROM (SELECT DISTINCT method FROM revealed) UNION ALL SELECT DISTINCT method, 'decision' FROM revealed),
wrong AS (SELECT method, table_name FROM t WHERE method = 'bank_nn' UNION ALL SELECT method, 'classes' FROM classified
    WHERE item % 10 = 0 UNION ALL SELECT method, 'reveal' FROM revealed WHERE item % 10 = 1)
SELECT table_name, side, method, count(*) AS row_count FROM wrong, (VALUES ('stored_only'), ('fresh_only')) s(side) GROUP BY ALL
UNION ALL SELECT 'cases', 'stored_only', method, count(*) FROM (SELECT method, CASE WHEN true_class = 'normal'
    AND is_anomalous THEN 'fp' WHEN true_class = 'anomaly' AND NOT is_anomalous THEN 'fn' END AS k,
    row_number() OVER (PARTITION BY method, CASE WHEN true_class = 'normal' AND is_anomalous THEN 'fp' WHEN true_class = 'anomaly'
    AND NOT is_anomalous THEN 'fn' END ORDER BY item) AS r FROM revealed) WHERE k IS NOT NULL AND r = 1 GROUP BY method
UNION ALL SELECT 'cases', 'fresh_only', method, count(*) FROM (SELECT method, CASE WHEN true_class = 'normal'
    AND is_anomalous THEN 'fp' WHEN true_class = 'anomaly' AND NOT is_anomalous THEN 'fn' END AS k,
    row_number() OVER (PARTITION BY method, CASE WHEN true_class = 'normal' AND is_anomalous THEN 'fp' WHEN true_class = 'anomaly'
    AND NOT is_anomalous THEN 'fn' END ORDER BY item) AS r FROM revealed) WHERE k IS NOT NULL AND r = 1 GROUP BY method""")
def recomputed_tables(spark, sf_dir):
    """All tables of an evaluation, each with some rows changed, against their recomputation from the scores."""
    cal, fin, labels = staged(I.calibration(spark, sf_dir)), staged(I.final_test(spark, sf_dir)), I.labels(spark, sf_dir)
    fresh = reproduce.evaluation_tables(cal, fin, labels)
    bank, k = F.col("method") == "bank_nn", F.col("item") % 10
    stored = dict(fresh)
    stored["thresholds"] = fresh["thresholds"].withColumn("threshold", F.when(bank, F.col("threshold") + 1).otherwise(F.col("threshold")))
    stored["classes"] = fresh["classes"].withColumn("is_anomalous", F.col("is_anomalous") != (k == 0))
    stored["reveal"] = fresh["reveal"].withColumn("true_class", F.when(k == 1, "unknown").otherwise(F.col("true_class")))
    stored["metrics"] = fresh["metrics"].withColumn("true_positive", F.col("true_positive") + bank.cast("int"))
    stored["cases"] = fresh["cases"].withColumn("score", F.when(F.col("case_rank") == 1, F.col("score") + 1).otherwise(F.col("score")))
    stored["decision"] = fresh["decision"].withColumn("decision", F.when(bank, "ADOPT").otherwise(F.col("decision")))
    out = reproduce.recomputed_all(stored, fresh)
    return out.select(
        "table_name", "side", F.get_json_object("row_json", "$.method").alias("method")
    ).groupBy("table_name", "side", "method").agg(F.count(F.lit(1)).alias("row_count"))


PASSES = "passes AS (SELECT method, item, p, score_status, failure_code, score + CASE WHEN p = 2 AND item % 100 = 1 THEN 1e-3 ELSE 0 END AS score, (item * 7 + p) % 1000 AS duration FROM final_test, (VALUES (0), (1), (2)) q(p))"


@query("label_free_summary", f"""WITH {I.CLASSIFIED_SQL}, {PASSES},
one AS (SELECT method, count(*) AS item_count, count(*) FILTER (WHERE score_status = 'ok') AS ok_count,
    count(*) FILTER (WHERE score_status = 'failed') AS failed_count, count(*) FILTER (WHERE is_anomalous) AS anomalous_count,
    min(score) AS min_score, max(score) AS max_score, true AS classification_agrees FROM classified GROUP BY method),
two AS (SELECT p.method, count(*) AS observation_count, round(max(abs(s.score - p.score)), 9) AS max_pass_difference,
    bool_and(abs(s.score - p.score) <= 1e-6) AS passes_agree, median(duration) AS median_duration FROM passes p
    JOIN final_test s ON s.method = p.method AND s.item = p.item GROUP BY p.method)
SELECT * FROM one JOIN two USING (method)""")
def label_free_summary(spark, sf_dir):
    s = I.final_test(spark, sf_dir)
    timed = s.withColumn("p", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumn("duration", (F.col("item") * 7 + F.col("p")) % 1000)
    timed = timed.withColumn("score", F.col("score") + F.when((F.col("p") == 2) & (F.col("item") % 100 == 1), F.lit(1e-3)).otherwise(F.lit(0.0)))
    return reproduce.label_free_summary(s, I.classified(spark, sf_dir), timed).withColumn("max_pass_difference", F.round("max_pass_difference", 9))


@query(
    "all_method_scores",
    f"WITH {I.SCORES_SQL} SELECT method, count(*) AS item_count, round(sum(CASE WHEN score_status = 'ok' THEN score END), "
    f"6) AS score_total FROM scores GROUP BY method"
)
def all_method_scores(spark, sf_dir):
    s = I.scores(spark, sf_dir)
    return s.groupBy("method").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.round(F.sum(F.when(F.col("score_status") == "ok", F.col("score"))), 6).alias("score_total")
    )


@query(
    "diagnostics_json",
    f"""WITH {I.CLASSIFIED_SQL} SELECT method, item, CASE method
    WHEN 'bank_nn' THEN '{{"is_anomalous":' || is_anomalous || ',"reason":"' || decision_reason || '"}}'
    WHEN 'position_zscore' THEN '{{"code":' || coalesce('"' || failure_code || '"', 'null') || ',"item":' || item || '}}' END AS diagnostics_json FROM classified"""
)
def diagnostics_json(spark, sf_dir):
    """Each method's own fields, sorted; one method has none."""
    packed = {
        "bank_nn": {"reason": F.col("decision_reason"), "is_anomalous": F.col("is_anomalous")},
        "position_zscore": {"item": F.col("item"), "code": F.col("failure_code")}
    }
    return I.classified(spark, sf_dir).select("method", "item", sc.diagnostics(F.col("method"), packed).alias("diagnostics_json"))


@query("stage_guard", f"""WITH {I.CALIBRATION_SQL}, st AS (
  SELECT 1 AS stage_order, 'calibration' AS stage, count(*) AS expected_count, count(*) AS observed_count, true AS agree FROM calibration UNION ALL
  SELECT 2, 'scoring', count(*), count(*), count(*) FILTER (WHERE item % 100 = 1) = 0 FROM final_test UNION ALL
    SELECT 3, 'reveal', count(*), 0, false FROM final_test UNION ALL SELECT 4, 'decision', 3, 3, true FROM cuts WHERE method = 'bank_nn'),
g AS (SELECT *, min(CASE WHEN observed_count = 0 THEN stage_order END) OVER () AS gap FROM st)
SELECT stage_order, stage, expected_count, observed_count, CASE WHEN observed_count > 0 AND stage_order > gap THEN 'ran_early'
    WHEN observed_count = 0 THEN 'due' WHEN observed_count <> expected_count OR NOT agree THEN 'disagrees' ELSE 'done' END AS stage_state FROM g""")
def stage_guard(spark, sf_dir):
    """A stage that is done, one of as many rows with another digest, one that is due, and one that ran early."""
    cal, fin = staged(I.calibration(spark, sf_dir)), staged(I.final_test(spark, sf_dir))
    moved = fin.withColumn("score", F.when(F.col("item") % 100 == 1, F.col("score") + 1).otherwise(F.col("score")))
    cuts = staged(sc.thresholds(cal))
    stages = (("calibration", cal, cal), ("scoring", fin, moved), ("reveal", fin, fin.limit(0)), ("decision", cuts, cuts))
    out = None
    for i, (name, expected, observed) in enumerate(stages):
        one = reproduce.stage_facts(expected, observed).select(F.lit(i + 1).alias("stage_order"), F.lit(name).alias("stage"), "*")
        out = one if out is None else out.unionByName(one)
    return reproduce.stage_guard(out).drop("digests_agree")


@query(
    "window_share_by_pass",
    f"WITH {I.OBSERVATIONS_SQL} SELECT method, pass_index, count(*) AS observation_count, "
    f"count(*) FILTER (WHERE score_status = 'failed') AS failed_count FROM observations GROUP BY ALL"
)
def window_share_by_pass(spark, sf_dir):
    o = I.observations(spark, sf_dir)
    return o.groupBy("method", F.col("pass_index").cast("long").alias("pass_index")).agg(
        F.count(F.lit(1)).alias("observation_count"), F.count_if(F.col("score_status") == "failed").alias("failed_count")
    )

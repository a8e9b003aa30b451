"""Queries over whole-table contracts: collections, orders, durations, decisions, latency tables, manifests, stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoregate.functions import scalars as S
from scoregate.operators import contracts as c, evaluation as ev, reproduce, scores as sc
from scoregate.plans import data_queries as dq, inputs as I, score_queries as sq
from scoregate.plans.registry import query
from scoregate.sources.stages import staged


@query("typed_row_violations", """SELECT 'l_tax:not_a_int' AS rule, count(*) AS row_count FROM lineitem WHERE l_linenumber % 3 = 0
    UNION ALL SELECT 'run:changed', count(*) FROM lineitem WHERE l_linenumber = 2
UNION ALL SELECT 'run:malformed', count(*) FROM lineitem WHERE l_linenumber = 2 UNION ALL SELECT 'digest:malformed', count(*)
    FROM lineitem WHERE l_linenumber = 4""")
def typed_row_violations(spark, sf_dir):
    """Lines as text rows of a run: some numbers aren't whole, some runs and digests aren't what the contract says."""
    n = F.col("l_linenumber")
    rows = I.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.when(n % 3 == 0, "0.5").otherwise("7").alias("l_tax"),
        F.when(n == 2, "Run 2").otherwise("run-1").alias("run"), F.when(n == 4, "xyz").otherwise(F.sha2(n.cast("string"), 256)).alias("digest"),
    )
    fields = [c.Field("l_tax", kind="int"), c.Field("run", fixed="run-1", pattern=S.RUN_ID), c.Field("digest", pattern=S.SHA256)]
    return c.row_violations(rows, fields, "key").groupBy("rule").agg(F.count(F.lit(1)).alias("row_count"))


@query("collection_violations", f"""WITH {I.OBSERVATIONS_SQL}, o AS (SELECT method, item, CASE WHEN pass_index = 2 THEN 5
    ELSE pass_index END AS p FROM observations UNION ALL SELECT method, item, pass_index FROM observations WHERE pass_index = 0 AND item % 10 = 0),
g AS (SELECT method || '|' || item AS k, count(*) AS n, min(p) = 0 AND max(p) = count(*) - 1
    AND count(DISTINCT p) = count(*) AS whole FROM o GROUP BY method, item)
SELECT 'mixed_runs' AS rule, 'all' AS group_key, count(DISTINCT method) AS row_count FROM observations HAVING count(DISTINCT method) > 1 UNION ALL
SELECT 'duplicate_key', method || '|' || item || '|' || p, count(*) FROM o GROUP BY method, item, p HAVING count(*) > 1 UNION ALL
SELECT 'gap', k, n FROM g WHERE NOT whole UNION ALL SELECT 'wrong_count', k, n FROM g WHERE n <> 3""")
def collection_violations(spark, sf_dir):
    """Timed passes of which a third lies beyond a gap and some stand twice; their methods are taken for runs."""
    o = I.observations(spark, sf_dir).select("method", "item", F.col("pass_index").cast("long").alias("p"))
    rows = o.withColumn("p", F.when(F.col("p") == 2, 5).otherwise(F.col("p"))).unionByName(o.where("p = 0 and item % 10 = 0"))
    return c.collection_violations(rows, ["method", "item", "p"], ["method"], ["method", "item"], "p", exactly=3)


@query("canonical_order", f"""WITH {I.CLASSIFIED_SQL}, p AS (SELECT method, item, row_number() OVER (ORDER BY CASE method
    WHEN 'template_residual' THEN 1 WHEN 'position_zscore' THEN 2 ELSE 3 END, item) - 1 AS place FROM classified)
SELECT method, item, place, CASE WHEN item % 25 = 2 THEN place + 1 END AS position FROM p WHERE item % 25 IN (2, 3)""")
def canonical_order(spark, sf_dir):
    """Rows in the contract's order, some of which say another position or none."""
    methods = ["template_residual", "position_zscore", "bank_nn"]
    rows = staged(I.classified(spark, sf_dir).select("method", "item"))
    key = rows.withColumn("one", F.lit(1)).withColumn("rank", F.array_position(F.array(*map(F.lit, methods)), F.col("method")))
    from scoregate.operators.prefix import ordinals

    placed = ordinals(key, ["one"], ["rank", "item"], "n")
    k, own = F.col("item") % 25, F.col("n") - 1
    told = placed.select("method", "item", F.when(k == 2, own + 1).when(k != 3, own).alias("position"))
    return c.order_violations(told, "position", methods, ["item"])


@query("duration_violations", f"""WITH {I.OBSERVATIONS_SQL}, o AS (SELECT method, item, pass_index, event_id % 4 AS k,
    method = 'click' AS own FROM observations)
SELECT method, item, pass_index::BIGINT AS pass_index, unnest(CASE WHEN own AND k = 0 THEN ['adapter_missing', 'duration_sum']
    WHEN NOT own AND k = 0 THEN ['adapter_forbidden'] ELSE ['duration_sum'] END) AS rule FROM o WHERE k = 0 OR k = 1""")
def duration_violations(spark, sf_dir):
    """Of four observations one has its adapter time where none belongs, or lacks it, and one has a wrong sum."""
    own, k = F.col("method") == "click", F.col("event_id") % 4
    o = I.observations(spark, sf_dir)
    adapter = F.when(own & (k != 0), F.lit(2.0)).when(~own & (k == 0), F.lit(2.0))
    total = F.col("duration") + F.when(own, F.lit(2.0)).otherwise(F.lit(0.0)) + F.when(k == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    rows = o.select(
        "method",
        "item",
        F.col("pass_index").cast("long").alias("pass_index"),
        adapter.alias("adapter_duration"),
        F.col("duration").alias("scorer_duration"),
        total.alias("duration")
    )
    return c.duration_violations(rows, ("click",))


@query(
    "reproduction_violations",
    f"""WITH {sq.REPRO_SQL} SELECT method, item, unnest(CASE item % 50 WHEN 7 THEN ['difference'] ELSE ['tolerance'] END) AS rule
    FROM cmp WHERE item % 50 IN (7, 8)"""
)
def reproduction_violations(spark, sf_dir):
    """A stored comparison with some differences and some verdicts changed."""
    k = F.col("item") % 50
    rows = sq._repeat(spark, sf_dir).withColumns(
        {
            "absolute_difference": F.when(k == 7, F.lit(9.0)).otherwise(F.col("absolute_difference")),
            "within_tolerance": F.col("within_tolerance") != (k == 8)
        }
    )
    return c.reproduction_violations(rows)


@query("case_violations", f"""WITH {I.CLASSIFIED_SQL}, e AS (SELECT method, item, CASE WHEN true_class = 'normal'
    AND is_anomalous THEN 'false_positive' WHEN true_class = 'anomaly' AND NOT is_anomalous THEN 'false_negative' END AS t, score FROM revealed),
r AS (SELECT *, row_number() OVER (PARTITION BY method, t ORDER BY CASE WHEN t = 'false_positive' THEN -score
    ELSE score END, item) AS k FROM e WHERE t IS NOT NULL)
SELECT method, item, unnest(CASE k WHEN 1 THEN ['margin'] WHEN 2 THEN ['case_type', 'true_class', 'predicted_class'][1:CASE
    WHEN t = 'false_positive' THEN 3 ELSE 1 END] WHEN 3 THEN ['true_class'] ELSE ['predicted_class'] END) AS rule FROM r WHERE k <= 4""")
def case_violations(spark, sf_dir):
    """Error cases of which each of the first four has another fault."""
    k = F.col("case_rank")
    rows = ev.error_cases(I.revealed(spark, sf_dir), 5).withColumns({
        "score_margin": F.when(k == 1, F.lit(99.0)).otherwise(F.col("score_margin")), "case_type": F.when(k == 2, "other").otherwise(F.col("case_type")),
        "true_class": F.when(k == 3, "odd").otherwise(F.col("true_class")), "predicted_class": F.when(k == 4, "odd").otherwise(F.col("predicted_class")),
    })
    return c.case_violations(rows)


@query("subset_violations", f"""WITH {I.CLASSIFIED_SQL}, f AS (SELECT method, item FROM classified WHERE score_status = 'failed'
    OR item % 40 = 1), a AS (SELECT method, item FROM classified WHERE is_anomalous UNION SELECT method, -item - 1 FROM classified WHERE item % 60 = 2)
SELECT *, 'failed_not_anomalous' AS rule FROM (SELECT * FROM f EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'anomalous_not_scored'
    FROM (SELECT * FROM a EXCEPT SELECT method, item FROM classified)""")
def subset_violations(spark, sf_dir):
    """Some rows are called failed without being anomalous, some anomalous ones were never scored."""
    rows = staged(I.classified(spark, sf_dir))
    failed = rows.where((F.col("score_status") == "failed") | (F.col("item") % 40 == 1))
    anomalous = rows.where("is_anomalous").select("method", "item").unionByName(
        rows.where("item % 60 = 2").select("method", (-F.col("item") - 1).alias("item"))
    )
    return sc.subset_violations(rows, anomalous, failed, ["method", "item"])


@query(
    "timing_failures",
    f"WITH {I.OBSERVATIONS_SQL} SELECT method, item, count(*) AS failed_passes, min(pass_index)::BIGINT AS first_failed_pass "
    f"FROM observations WHERE score_status = 'failed' GROUP BY method, item"
)
def timing_failures(spark, sf_dir):
    return ev.timing_failures(I.observations(spark, sf_dir)).withColumn("first_failed_pass", F.col("first_failed_pass").cast("long"))


@query("latency_violations", f"""WITH {sq.LATENCY_SQL} SELECT method, rule
    FROM latency, (VALUES ('pass_set'), ('item_set'), ('repeated'), ('status')) r(rule) WHERE
  CASE rule WHEN 'pass_set' THEN method IN (SELECT method FROM observations WHERE pass_index >= 4)
    WHEN 'item_set' THEN method IN (SELECT method FROM observations GROUP BY method, item HAVING count(DISTINCT pass_index) <> 4)
    WHEN 'repeated' THEN method = 'view' ELSE method IN (SELECT method FROM observations GROUP BY method, item HAVING count(DISTINCT score_status) <> 1) END
UNION ALL SELECT method, 'summary' FROM latency WHERE method = 'click'""")
def latency_violations(spark, sf_dir):
    """A latency table held to four passes, one method of which has passes twice, and whose summary is of another median for one."""
    o = I.observations(spark, sf_dir).select("method", "item", F.col("pass_index").cast("long").alias("pass_index"), "score_status", "duration")
    rows = staged(o.unionByName(o.where("method = 'view' and pass_index = 0")))
    stored = ev.latency(rows, ["method"]).withColumn(
        "median_duration", F.when(F.col("method") == "click", F.col("median_duration") + 1).otherwise(F.col("median_duration"))
    )
    return c.latency_violations(rows, stored, 4)


@query("eight_gates", f"""WITH {sq.FACTS_SQL}, eight AS (SELECT method, g.gate_order, g.gate, CASE g.gate_order WHEN 1 THEN CASE
    WHEN method = 'bank_nn' THEN 0.0 ELSE 1.0 END WHEN 2 THEN 0.0 WHEN 3 THEN fpr WHEN 4 THEN recall WHEN 5 THEN p95_duration
    WHEN 6 THEN reference_count WHEN 7 THEN anomaly_training_labels ELSE reproduced END::DOUBLE AS measured, g.op, g.lim
  FROM facts, (VALUES (1, 'method_fit', '>=', 1.0::DOUBLE), (2, 'test_leakage', '<=', 0.0::DOUBLE), (3, 'final_test_normal_fpr',
    '<=', 0.05::DOUBLE), (4, 'final_test_anomaly_recall', '>=', 0.9::DOUBLE), (5, 'cpu_p95_scoring_latency', '<=', 1.0::DOUBLE),
    (6, 'normal_reference_count', '==', 20.0::DOUBLE), (7, 'anomaly_training_labels', '<=', 0.0::DOUBLE), (8, 'reproducibility',
    '>=', 1.0::DOUBLE)) g(gate_order, gate, op, lim)),
ok AS (SELECT *, CASE op WHEN '<=' THEN measured <= lim WHEN '==' THEN measured = lim ELSE measured >= lim END AS passed
    FROM eight), f AS (SELECT *, min(CASE WHEN NOT passed THEN gate_order END) OVER (PARTITION BY method) AS first_failed_order FROM ok)
SELECT method, gate_order, gate, measured, passed, CASE WHEN first_failed_order IS NULL
    OR gate_order < first_failed_order THEN 'pass' WHEN gate_order = first_failed_order THEN 'fail' ELSE 'not_evaluated' END AS gate_status FROM f""")
def eight_gates(spark, sf_dir):
    """The eight ordered gates: one method's fit failed, and no item of the final test may be among the references."""
    measured = sq.facts(spark, sf_dir).withColumns({"fit_ok": (F.col("method") != "bank_nn").cast("double")})
    leaked = I.calibration(spark, sf_dir).select("item").distinct().join(
        I.final_test(spark, sf_dir).select("item").distinct(), "item", "left_semi"
    ).agg(F.count(F.lit(1)).cast("double").alias("leaked_items"))
    gated = ev.short_circuit(ev.gates(measured.join(F.broadcast(leaked), F.lit(True)), ev.EIGHT_GATES))
    return gated.select("method", "gate_order", "gate", "measured", "passed", "gate_status")


@query("decision_violations", f"""WITH {sq.DECISION_SQL}, v AS (SELECT method, v
    FROM decisions, (VALUES ('none'), ('decision'), ('first_failed_gate'), ('condition')) t(v))
SELECT v.method || ':' || v AS method, unnest(CASE v WHEN 'condition' THEN CASE
    WHEN decision = 'ADOPT WITH CONDITIONS' THEN ['condition_missing'] ELSE ['condition_without_guardrail'] END
    WHEN 'none' THEN [] ELSE [v] END) AS rule FROM v JOIN decisions ON decisions.method = v.method""")
def decision_violations(spark, sf_dir):
    """Each method's decision as it is, and with its decision, its first failed gate or its condition wrong."""
    measured = sq.facts(spark, sf_dir)
    kinds = F.explode(F.array(*map(F.lit, ("none", "decision", "first_failed_gate", "condition")))).alias("v")
    name = F.concat("method", F.lit(":"), "v")
    gated = ev.short_circuit(ev.gates(measured)).select("*", kinds).withColumn("method", name)
    v, conditional = F.col("v"), F.col("decision") == "ADOPT WITH CONDITIONS"
    rows = sq.decisions(spark, sf_dir, measured).select("*", kinds).withColumns({
        "method": name, "first_failed_gate": F.when(v == "first_failed_gate", "unknown").otherwise(F.col("first_failed_gate")),
        "condition": F.when(v != "condition", F.col("condition")).when(~conditional, "some"),
        "decision": F.when(v == "decision", F.when(F.col("decision") == "REJECT", "ADOPT").otherwise("REJECT")).otherwise(F.col("decision")),
    })
    return c.decision_violations(rows, gated)


@query("manifest_report", f"""WITH {dq.SELECT_SQL}, m AS (SELECT record_id, CASE WHEN selection_rank <= 5 THEN 'reference'
    ELSE 'calibration' END AS partition, selection_rank FROM sel)
SELECT 'partitions_overlap' AS rule, record_id AS key FROM m WHERE selection_rank = 6 UNION ALL
    SELECT 'digest_malformed', record_id FROM m WHERE selection_rank = 7 UNION ALL
SELECT 'not_in_manifest', record_id FROM m WHERE selection_rank = 8 UNION ALL SELECT 'not_in_selection', record_id FROM m WHERE selection_rank = 6 UNION ALL
SELECT 'partition_count', partition FROM m GROUP BY partition HAVING partition = 'reference' OR count(*) FILTER (WHERE selection_rank = 8) > 0""")
def manifest_report(spark, sf_dir):
    """A manifest without the eighth record of each category, with the sixth in two partitions and a malformed digest at the seventh."""
    fresh = staged(dq.seeded_partitions(spark, sf_dir).withColumn("partition", F.when(F.col("selection_rank") <= 5, "reference").otherwise("calibration")))
    r = F.col("selection_rank")
    rows = fresh.where("selection_rank <> 8").select(
        "record_id",
        "category",
        F.col("path").alias("relative_path"),
        "partition",
        F.lit(None).cast("string").alias("label"),
        "selection_rank",
        F.when(r == 7, "no digest").otherwise(F.sha2("path", 256)).alias("content_sha256")
    )
    stored = rows.unionByName(rows.where(r == 6).withColumn("partition", F.lit("reference")))
    counts = fresh.groupBy("partition").agg(F.count(F.lit(1)).alias("expected_count"))
    # The sixth is one too many among the references; the calibration rows lack the eighth.
    return c.manifest_report(stored, fresh, counts)


@query("stage_projections", f"""WITH {I.CLASSIFIED_SQL} SELECT 'scores' AS stage, count(*) AS row_count, 5 + 2 AS column_count
    FROM final_test UNION ALL SELECT 'classifications', count(*), 8 + 2 FROM classified UNION ALL SELECT 'labels', count(DISTINCT item), 2 + 2 FROM revealed
UNION ALL SELECT 'failures', count(*), 3 + 2 FROM final_test WHERE score_status = 'failed' UNION ALL SELECT 'latencies', count(*), 5 + 2 FROM events""")
def stage_projections(spark, sf_dir):
    """What each stage writes of an evaluation's tables: its rows and the columns of its contract."""
    fin, shown = I.final_test(spark, sf_dir), staged(I.revealed(spark, sf_dir))
    tables = {"scores": fin, "classifications": shown, "labels": shown, "failures": fin, "latencies": I.observations(spark, sf_dir)}
    out = None
    for stage, df in tables.items():
        rows = sc.stage_rows(df, stage, "run-1", "final_test")
        one = rows.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(stage).alias("stage"), "row_count", F.lit(len(rows.columns)).alias("column_count"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "closed_failures",
    f"""WITH {I.RAW_SQL} SELECT method, count(*) FILTER (WHERE item % 97 <> 5) AS unknown_count, count(*) AS failed_count,
    count(*) AS anomalous_count FROM raw WHERE method = 'template_residual' GROUP BY method"""
)
def closed_failures(spark, sf_dir):
    """Scores of a method that has neither rule nor threshold: they fail closed and none is lost."""
    rules = I.rules(spark).where("method <> 'template_residual'")
    rows = sc.with_failures(I.raw_scores(spark, sf_dir), rules).where("method = 'template_residual'")
    cuts = spark.createDataFrame([("bank_nn", 0.5)], "method string, threshold double")
    own = F.col("item") % 97 == 5
    return sc.classify(rows, cuts).groupBy("method").agg(
        F.count_if((F.col("failure_code") == "METHOD_UNKNOWN") & ~own).alias("unknown_count"),
        F.count_if(F.col("score_status") == "failed").alias("failed_count"),
        F.count_if("is_anomalous").alias("anomalous_count")
    )


@query(
    "first_ten_reproduced",
    f"WITH {I.SCORES_SQL}, r AS (SELECT method, item, row_number() OVER (PARTITION BY method ORDER BY item) AS k FROM scores) "
    f"SELECT method, count(*) AS compared_count, false AS reproduced FROM r WHERE k <= 10 GROUP BY method"
)
def first_ten_reproduced(spark, sf_dir):
    """The first ten items of each method scored again, in another order: same scores, moved rows."""
    s = reproduce.first_items(I.scores(spark, sf_dir), 10)
    again = s.withColumn("item_order", 11 - F.col("item_order"))
    return reproduce.reproduction_summary(reproduce.compared(s, again, ["method", "item"], order="item_order")).select("method", "compared_count", "reproduced")

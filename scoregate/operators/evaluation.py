"""Reveal, metrics, error cases, latency, gates, method selection.

Defined cases: reveal is an inner join by exact key, to be made only where reveal_status says ok; everywhere else no row or
method is lost. A missing fact fails its gate, a method without evidence is rejected, a null duration counts as an observation
but has no rank. Repeated rows count as often as they stand; empty tables give empty results (reveal_status one row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from scoregate.functions import scalars as S
from scoregate.operators.prefix import held, median_and_more, null_safe_join, running


def reveal_status(items: DataFrame, labels: DataFrame, key: str = "item", order: str | None = None) -> DataFrame:
    """One row: what the exact-key join of items and labels would meet, checked in a fixed order: empty, invalid, duplicate,
    missing, extra and, where both sides carry an order column, out of order."""
    at = [F.min(order).alias("__sg_order")] if order else []
    left = items.groupBy(key).agg(F.count(F.lit(1)).alias("items"), *at)
    right = labels.groupBy(key).agg(
        F.count(F.lit(1)).alias("labels"),
        F.count_if(F.col("true_class").isin("normal", "anomaly")).alias("valid"),
        *(c.alias("__sg_label_order") for c in ([F.min(order)] if order else []))
    )
    moved = F.col("items").isNotNull() & F.col("labels").isNotNull() & ~F.col("__sg_order").eqNullSafe(F.col("__sg_label_order")) if order else F.lit(False)
    both = null_safe_join(left, right, [key], "full_outer").agg(
        F.coalesce(F.sum("labels"), F.lit(0)).alias("label_count"),
        F.coalesce(F.sum(F.col("labels") - F.col("valid")), F.lit(0)).alias("invalid_count"),
        F.count_if(F.col("labels") > 1).alias("duplicate_count"),
        F.count_if(F.col("items") > 1).alias("item_duplicate_count"),
        F.count_if(F.col("labels").isNull()).alias("missing_count"),
        F.count_if(F.col("items").isNull()).alias("extra_count"),
        F.count_if(moved).alias("moved_count"),
    )
    code = S.any_code(
        (F.col("label_count") == 0, "LABELS_EMPTY"),
        (F.col("invalid_count") > 0, "LABELS_INVALID"),
        (F.col("duplicate_count") > 0, "LABELS_DUPLICATE"),
        (F.col("item_duplicate_count") > 0, "ITEMS_DUPLICATE"),
        (F.col("missing_count") > 0, "LABELS_MISSING"),
        (F.col("extra_count") > 0, "LABELS_EXTRA"),
        (F.col("moved_count") > 0, "LABELS_MISORDERED")
    )
    return both.withColumn("status_code", F.coalesce(code, F.lit("ok")))


def reveal(classified: DataFrame, labels: DataFrame, key: str = "item") -> DataFrame:
    """Classified rows with their true class; decisions stay as they were made."""
    return classified.join(labels.select(key, "true_class"), key)


def coverage(scored: DataFrame, labelled: DataFrame, key: str = "item") -> DataFrame:
    """Keys on one side alone: (key, side)."""
    a, b = scored.select(key).distinct(), labelled.select(key).distinct()
    alone = lambda x, y, side: null_safe_join(x, y, [key], "left_anti").withColumn("side", F.lit(side))
    return alone(a, b, "unlabelled").unionByName(alone(b, a, "unscored"))


def confusion(revealed: DataFrame) -> DataFrame:
    """Counts, false positive rate and recall of each method; anomaly is the positive class, failed rows stay in."""
    true, said = F.col("true_class") == "anomaly", F.col("is_anomalous")
    out = revealed.groupBy("method").agg(
        F.count_if(true & said).alias("true_positive"), F.count_if(true & ~said).alias("false_negative"),
        F.count_if(~true & ~said).alias("true_negative"), F.count_if(~true & said).alias("false_positive"),
        F.count_if(F.col("score_status") == "failed").alias("score_failures"),
    )
    out = out.withColumn("fpr", F.try_divide("false_positive", F.col("false_positive") + F.col("true_negative"))).withColumn(
        "recall", F.try_divide("true_positive", F.col("true_positive") + F.col("false_negative"))
    )
    support = (F.col("true_positive") + F.col("false_negative") > 0) & (F.col("true_negative") + F.col("false_positive") > 0)
    return out.withColumn("metrics_status", F.when(support, "ok").otherwise("METRICS_CLASS_SUPPORT_INVALID"))


def ranking_quality(revealed: DataFrame) -> DataFrame:
    """AUROC with ties as half and average precision with tied scores as one step, from the distinct scores of each method. A method
    with a null score has neither: such a row has no place in the order."""
    steps = revealed.groupBy("method", "score").agg(
        F.count_if(F.col("true_class") == "anomaly").alias("pos"), F.count_if(F.col("true_class") == "normal").alias("neg")
    )
    r = running(steps, ["method"], "score", {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, descending=True)
    pos, neg = F.sum("pos"), F.sum("neg")
    auroc = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)) / (pos * neg)
    precision = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))) / pos
    both = (pos > 0) & (neg > 0) & (F.count_if(F.col("score").isNull()) == 0)
    return r.groupBy("method").agg(F.when(both, auroc).alias("auroc"), F.when(both, precision).alias("average_precision"))


def error_cases(revealed: DataFrame, most: int = 5) -> DataFrame:
    """The worst false positives (highest scores) and false negatives (lowest scores) of each method, ties by item."""
    case = F.when((F.col("true_class") == "normal") & F.col("is_anomalous"), "false_positive").when(
        (F.col("true_class") == "anomaly") & ~F.col("is_anomalous"), "false_negative"
    )
    signed = F.when(F.col("case_type") == "false_positive", -F.col("score")).otherwise(F.col("score"))
    order = Window.partitionBy("method", "case_type").orderBy("__sg_signed", "item")
    out = revealed.withColumn("case_type", case).where("case_type is not null").withColumn("__sg_signed", signed)
    return out.withColumn("case_rank", F.row_number().over(order)).where(F.col("case_rank") <= most).withColumn(
        "case_rank", F.col("case_rank").cast("long")
    ).drop("__sg_signed")


def latency(observations: DataFrame, groups: list[str], expected: Column | None = None) -> DataFrame:
    """Median, nearest-rank p95 over all observations and failures of each group; p95 only where all `expected` succeeded. Both
    are found by ranks over ranges of durations, so that a group with many rows is spread."""
    observations = held(observations, [*groups, "item", "score_status", "duration"])
    out = observations.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.count_if(F.col("score_status") == "failed").alias("failed_count"),
        F.count_distinct(F.when(F.col("score_status") == "failed", F.col("item"))).alias("failed_items"),
        F.ceil(F.lit(0.95) * F.count(F.lit(1))).alias("p95_rank"),
        F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"),
    )
    out = null_safe_join(out, median_and_more(observations, groups, "duration", {"p95_duration": 0.95}, "median_duration"), groups, "left")
    if expected is None:
        return out
    whole = (F.col("observation_count") == expected) & (F.col("failed_count") == 0)
    return out.withColumn("is_complete", whole).withColumn("complete_p95", F.when(whole, F.col("p95_duration")))


def timing_failures(observations: DataFrame, keys: tuple[str, ...] = ("method", "item")) -> DataFrame:
    """The items whose timing failed, with how many of their passes did and which was the first."""
    failed = observations.where(F.col("score_status") == "failed")
    return failed.groupBy(*keys).agg(F.count(F.lit(1)).alias("failed_passes"), F.min("pass_index").alias("first_failed_pass"))


def metrics_with_latency(metrics: DataFrame, timed: DataFrame) -> DataFrame:
    """Metrics and latency of each method, with whether both are there and cover as many items: evidence_state is ok,
    metrics_missing, latency_missing or item_count. Both sides have method and item_count."""
    joined = null_safe_join(metrics, timed.withColumnRenamed("item_count", "timed_items"), ["method"], "full_outer")
    state = F.when(F.col("item_count").isNull(), "metrics_missing").when(F.col("timed_items").isNull(), "latency_missing").when(
        F.col("item_count") != F.col("timed_items"), "item_count"
    ).otherwise("ok")
    return joined.withColumn("evidence_state", state)


#: Gate, measured column, comparison, limit column: rows of facts carry both columns.
GATES = (
    (1, "normal_fpr", "fpr", "<=", 0.05), (2, "anomaly_recall", "recall", ">=", 0.90), (3, "cpu_p95", "p95_duration", "<=", 1.0),
    (4, "normal_references", "reference_count", "<=", 20.0), (
        5, "no_anomaly_training", "anomaly_training_labels", "<=", 0.0
    ), (6, "reproducible", "reproduced", ">=", 1.0),
)
#: The eight gates of the later contract: fit and leakage come first, and exactly 20 references.
EIGHT_GATES = (
    (1, "method_fit", "fit_ok", ">=", 1.0), (2, "test_leakage", "leaked_items", "<=", 0.0), (
        3, "final_test_normal_fpr", "fpr", "<=", 0.05
    ), (
        4, "final_test_anomaly_recall", "recall", ">=", 0.90
    ),
    (5, "cpu_p95_scoring_latency", "p95_duration", "<=", 1.0), (6, "normal_reference_count", "reference_count", "==", 20.0), (
        7, "anomaly_training_labels", "anomaly_training_labels", "<=", 0.0
    ), (8, "reproducibility", "reproduced", ">=", 1.0),
)


def gates(facts: DataFrame, rules=GATES) -> DataFrame:
    """One row for each method and gate: measured, limit, passed. Every gate is evaluated; a missing fact fails it."""
    rows = F.array(
        *(
            F.struct(
                F.lit(i).alias("gate_order"),
                F.lit(n).alias("gate"),
                F.col(c).cast("double").alias("measured"),
                F.lit(op).alias("comparison"),
                F.lit(float(limit)).alias("gate_limit")
            )
            for i, n, c, op, limit in rules
        )
    )
    out = facts.select("method", F.inline(rows))
    measured, limit = F.col("measured"), F.col("gate_limit")
    passed = F.when(F.col("comparison") == "<=", measured <= limit).when(F.col("comparison") == "==", measured == limit).otherwise(measured >= limit)
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))


def short_circuit(gated: DataFrame) -> DataFrame:
    """The gates up to the first failure; those after it are not evaluated."""
    first = F.min(F.when(~F.col("passed"), F.col("gate_order"))).over(Window.partitionBy("method"))
    state = F.when(first.isNull() | (F.col("gate_order") < first), "pass").when(F.col("gate_order") == first, "fail").otherwise("not_evaluated")
    return gated.withColumn("gate_status", state).withColumn("first_failed_order", first)


def decide(gated: DataFrame, evidence: DataFrame) -> DataFrame:
    """ADOPT, ADOPT WITH CONDITIONS or REJECT for each method, with the reason: evidence_invalid, gate_failed, leakage, contradicted,
    guardrail or all_passed, the first that holds. evidence: method, leakage, contradicted, guardrail, condition and maybe rationale.

    It is valid if the three facts are known, a condition stands where a guardrail is asked for and nowhere else, and condition and
    rationale are trimmed texts of at most 500 characters. A method without valid evidence is rejected, whatever it measured; a
    condition is handed on only with the decision that carries it."""
    summary = gated.groupBy("method").agg(
        F.bool_and("passed").alias("all_passed"),
        F.min(F.when(~F.col("passed"), F.struct("gate_order", "gate")))["gate"].alias("first_failed_gate")
    )
    known = F.col("leakage").isNotNull() & F.col("contradicted").isNotNull() & F.col("guardrail").isNotNull()
    valid = known & F.when(F.col("guardrail"), S.short_text(F.col("condition"))).otherwise(F.col("condition").isNull())
    if "rationale" in evidence.columns:
        valid = valid & S.short_text(F.col("rationale"))
    reason = S.any_code(
        (~F.col("evidence_valid"), "evidence_invalid"), (~F.coalesce(F.col("all_passed"), F.lit(False)), "gate_failed"), (F.col("leakage"), "leakage"),
        (F.col("contradicted"), "contradicted"), (F.col("guardrail"), "guardrail"), (F.lit(True), "all_passed"),
    )
    joined = null_safe_join(
        summary, F.broadcast(evidence), ["method"], "left"
    ).withColumn("evidence_valid", F.coalesce(valid, F.lit(False))).withColumn("decision_reason", reason)
    decision = F.when(F.col("decision_reason") == "all_passed", "ADOPT").when(
        F.col("decision_reason") == "guardrail", "ADOPT WITH CONDITIONS"
    ).otherwise("REJECT")
    return joined.withColumn("decision", decision).withColumn("condition", F.when(F.col("decision_reason") == "guardrail", F.col("condition")))


def complexity(method: Column, methods: list[str]) -> Column:
    """A method's place in the fixed order from simple to complex; methods outside it come last."""
    place = F.array_position(F.array(*map(F.lit, methods)), method)
    return F.when(place > 0, place).otherwise(len(methods) + 1).cast("long")


def select_method(candidates: DataFrame) -> DataFrame:
    """Methods in order of preference: decision, recall, false positive rate, p95, median, complexity; rank 1 is selected. The
    table has a row for each method."""
    rank = F.when(F.col("decision") == "ADOPT", 0).when(F.col("decision") == "ADOPT WITH CONDITIONS", 1).otherwise(2)
    order = Window.orderBy("__sg_rank", F.desc("recall"), "fpr", "p95_duration", "median_duration", "complexity", "method")
    best = F.min("__sg_rank").over(Window.partitionBy())
    out = candidates.withColumn("__sg_rank", rank)
    return out.withColumn("preference", F.row_number().over(order).cast("long")).withColumn(
        "project_decision", F.when(best == 2, "REJECT").otherwise(F.first("decision").over(order))
    ).drop("__sg_rank")


def prefer(candidates: DataFrame, group: str, preference: list) -> DataFrame:
    """The first of the preferred candidates that passed in each group, null if none did."""
    place = F.array_position(F.array(*map(F.lit, preference)), F.col("candidate"))
    ok = F.col("passed") & (place > 0)
    return candidates.groupBy(group).agg(F.min_by(F.when(ok, F.col("candidate")), F.when(ok, place)).alias("selected"))

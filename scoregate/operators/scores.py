"""Score tables: failure substitution, calibration thresholds, classification, summaries.

A score table has method, item, score_status (`ok` or `failed`), failure_code (null if ok) and score. A rule table has
method, low, high, inclusive and failure_score, a row for each method.

Defined cases: no row is lost. A method without a rule or threshold, the null method too, fails closed: its scores are
failures with the code METHOD_UNKNOWN, its classes are anomalous for the reason threshold_missing, its states break the
rule unknown_method. Repeated rows stay; empty tables give empty results; helper columns begin with ``__sg_``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scoregate.functions import scalars as S
from scoregate.operators.prefix import at_ranks, null_safe_join


def with_failures(raw: DataFrame, rules: DataFrame, code: str = "SCORE_INVALID") -> DataFrame:
    """Scores that are missing, not finite or already marked failed become the method's failure score with a code."""
    known = rules.select("method", F.col("failure_score").alias("__sg_failure"), F.lit(True).alias("__sg_known"))
    bad = F.coalesce((F.col("score_status") == "failed") | ~S.finite(F.col("score")), F.lit(True)) | F.col("__sg_known").isNull()
    joined = null_safe_join(raw, F.broadcast(known), ["method"], "left").withColumn("__sg_bad", bad)
    codes = F.coalesce(F.when(F.col("__sg_known").isNull(), "METHOD_UNKNOWN"), "failure_code", F.lit(code))
    return joined.select(
        *(c for c in raw.columns if c not in ("score_status", "failure_code", "score")),
        F.when(F.col("__sg_bad"), "failed").otherwise("ok").alias("score_status"),
        F.when(F.col("__sg_bad"), codes).alias("failure_code"),
        F.when(F.col("__sg_bad"), F.col("__sg_failure")).otherwise(F.col("score")).alias("score"),
    )


def state_violations(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows whose status, code and score don't go together: method, item, rule."""
    ok, failed = F.col("score_status") == "ok", F.col("score_status") == "failed"
    inside = F.when(
        F.col("inclusive"), F.col("score").between(F.col("low"), F.col("high"))
    ).otherwise((F.col("score") > F.col("low")) & (F.col("score") < F.col("high")))
    rule = S.any_code(
        (F.col("__sg_known").isNull(), "unknown_method"),
        (~S.finite(F.col("score")), "score_not_finite"),
        (F.coalesce(~(ok | failed), F.lit(True)), "unknown_status"),
        (ok & F.col("failure_code").isNotNull(), "code_without_failure"),
        (failed & F.col("failure_code").isNull(), "failure_without_code"),
        (ok & ~inside, "score_out_of_range"),
        (failed & (F.col("score") != F.col("failure_score")), "wrong_failure_score"),
    )
    joined = null_safe_join(scores, F.broadcast(rules.withColumn("__sg_known", F.lit(True))), ["method"], "left")
    return joined.select("method", "item", rule.alias("rule")).where("rule is not null")


def thresholds(scores: DataFrame, quantile: float = 0.95) -> DataFrame:
    """The nearest-rank threshold of each method with the row it comes from: rank ceil(q n) in the order (score, item). Null scores
    have no rank and don't count: failures must carry their failure score. Only the range that holds the rank is ordered."""
    rank = F.ceil(F.lit(float(quantile)) * F.col("__sg_count").cast("double"))
    row = at_ranks(scores, ["method"], "score", {"threshold": rank}, ["item"], ["item"])
    return row.select(
        "method",
        F.col("__sg_count").alias("item_count"),
        F.col("rank").alias("threshold_rank"),
        F.col("score").alias("threshold"),
        F.col("item").alias("threshold_item")
    )


def verdicts() -> dict[str, Column]:
    """What score_status, score and threshold of a row say: flag, class, reason and margin. A row without one of them is anomalous."""
    failed, above = F.col("score_status") == "failed", F.col("score") > F.col("threshold")
    said = F.coalesce(failed, F.lit(True)) | F.coalesce(above, F.lit(True))
    return {
        "is_anomalous": said,
        "predicted_class": F.when(said, "anomaly").otherwise("normal"),
        "decision_reason": F.when(failed, "score_failed").when(
            F.col("threshold").isNull(), "threshold_missing"
        ).when(above, "above_threshold").when(said, "score_missing").otherwise("within_threshold"),
        "score_margin": F.col("score") - F.col("threshold"),
    }


def classify(scores: DataFrame, cuts: DataFrame) -> DataFrame:
    """Fixed-threshold classes: anomalous if failed or strictly above; cuts has a row (method, threshold) for each method."""
    return null_safe_join(scores, F.broadcast(cuts.select("method", "threshold")), ["method"], "left").withColumns(verdicts())


def realized_rate(classified: DataFrame) -> DataFrame:
    """Share of calibration rows that the threshold calls anomalous, failed ones included."""
    return classified.groupBy("method").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if("is_anomalous").alias("above_count"),
        (F.count_if("is_anomalous") / F.count(F.lit(1))).alias("realized_rate")
    )


def class_counts(classified: DataFrame) -> DataFrame:
    """Normal, anomalous and failed rows of each method, and whether they add up."""
    out = classified.groupBy("method").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if(F.col("predicted_class") == "normal").alias("normal_count"),
        F.count_if(F.col("predicted_class") == "anomaly").alias("anomalous_count"),
        F.count_if(F.col("score_status") == "failed").alias("failed_count"),
    )
    return out.withColumn(
        "sums_agree",
        (
            F.col("normal_count") + F.col("anomalous_count") == F.col("item_count")
        ) & (F.col("failed_count") <= F.col("anomalous_count"))
    )


def fit_summary(fits: DataFrame, least: int) -> DataFrame:
    """Successes and failures of each method's fit; too few successes fail it."""
    out = fits.groupBy("method").agg(
        F.count_if(F.col("score_status") == "ok").alias("success_count"),
        F.count_if(F.col("score_status") == "failed").alias("failure_count")
    )
    return out.withColumn("fit_status", F.when(F.col("success_count") < least, "fit_failed").otherwise("ok"))


def subset_violations(scored: DataFrame, anomalous: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break failed <= anomalous <= scored: keys and rule (failed_not_anomalous or anomalous_not_scored)."""
    outside = lambda small, large, rule: null_safe_join(small.select(*keys).distinct(), large.select(*keys).distinct(), keys, "left_anti").withColumn("rule", F.lit(rule))
    return outside(failed, anomalous, "failed_not_anomalous").unionByName(outside(anomalous, scored, "anomalous_not_scored"))


def total_duration(method: Column, adapter: Column, scorer: Column, with_adapter: tuple[str, ...]) -> tuple[Column, Column]:
    """(duration, whether the times contradict the method): methods with an adapter add its time, all others must not have one."""
    own = F.coalesce(method.isin(*with_adapter), F.lit(False))
    wrong = F.when(own, adapter.isNull() | scorer.isNull()).otherwise(adapter.isNotNull() | scorer.isNull())
    return F.when(~wrong, F.when(own, adapter + scorer).otherwise(scorer)), wrong


def diagnostics(method: Column, packed: dict[str, dict[str, Column]]) -> Column:
    """Each method's own diagnostics as canonical JSON (sorted keys, nulls written out); null for a method without any."""
    out = F.lit(None).cast("string")
    for name, values in packed.items():
        fields = F.struct(*(c.alias(k) for k, c in sorted(values.items())))
        out = F.when(method == name, F.to_json(fields, {"ignoreNullFields": "false"})).otherwise(out)
    return out


#: Columns of the score table's projections, by stage.
STAGES = {
    "scores": ("method", "item", "score_status", "failure_code", "score"),
    "classifications": ("method", "item", "is_anomalous", "predicted_class", "decision_reason", "score", "threshold", "score_margin"),
    "labels": ("item", "true_class"),
    "latencies": ("method", "item", "pass_index", "score_status", "duration"),
    "failures": ("method", "item", "failure_code"),
}


def stage_rows(table: DataFrame, stage: str, run_id: str, run_kind: str) -> DataFrame:
    """A table's projection for one stage, with the run's id and kind in front. Failures are the failed rows alone, labels a row for
    each item. Order comes at the sink (contracts.canonical_order)."""
    if stage == "failures":
        table = table.where(F.col("score_status") == "failed")
    out = table.select(F.lit(run_id).alias("run_id"), F.lit(run_kind).alias("run_kind"), *STAGES[stage])
    return out.distinct() if stage == "labels" else out

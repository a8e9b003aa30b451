"""Repeatability: expected against reproduced scores, timed passes, and tables recomputed as a whole.

Defined cases: rows that only one side has stay and count against the repetition, as do copies of a key beyond those of the
other side; null keys equal null keys; null scores never agree; empty tables give empty results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from scoregate.operators import evaluation as ev, scores as S
from scoregate.operators.prefix import median_and_more, null_safe_join
from scoregate.sources.bundles import content_digest
from scoregate.sources.stages import staged

TOLERANCE = 1e-6


def agreement(tolerance: float = TOLERANCE) -> tuple[Column, Column]:
    """The difference of a pair's scores, and whether the pair agrees: compared, of one status and code, and near enough."""
    difference = F.abs(F.col("expected_score") - F.col("reproduced_score"))
    same = (F.col("expected_score_status") == F.col("reproduced_score_status")) & F.col("expected_failure_code").eqNullSafe(F.col("reproduced_failure_code"))
    return difference, F.coalesce(same & (difference <= tolerance) & (F.col("pair_state") == "compared"), F.lit(False))


def compared(expected: DataFrame, reproduced: DataFrame, keys: list[str], tolerance: float = TOLERANCE, order: str | None = None) -> DataFrame:
    """Expected and reproduced score states of each key with their difference; every mismatch is kept and flagged. pair_state is
    compared, absent (not reproduced), extra (not expected) or, where an order column is named, moved. Repeated keys are
    paired in the order of their states; what is left over is absent or extra."""
    names = ("score_status", "failure_code", "score", *([order] if order else []))
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy(*names))
    a = expected.withColumn("__sg_copy", copy).select(*keys, "__sg_copy", F.lit(True).alias("__sg_a"), *(F.col(n).alias(f"expected_{n}") for n in names))
    b = reproduced.withColumn("__sg_copy", copy).select(*keys, "__sg_copy", F.lit(True).alias("__sg_b"), *(F.col(n).alias(f"reproduced_{n}") for n in names))
    joined = null_safe_join(a, b, [*keys, "__sg_copy"], "full_outer").drop("__sg_copy")
    moved = ~F.col(f"expected_{order}").eqNullSafe(F.col(f"reproduced_{order}")) if order else F.lit(False)
    state = F.when(F.col("__sg_b").isNull(), "absent").when(F.col("__sg_a").isNull(), "extra").when(moved, "moved").otherwise("compared")
    difference, agrees = agreement(tolerance)
    return joined.withColumn("pair_state", state).drop("__sg_a", "__sg_b").withColumn("absolute_difference", difference).withColumn("within_tolerance", agrees)


def reproduction_summary(comparison: DataFrame) -> DataFrame:
    """Compared, absent and extra items, largest difference and whether all are within tolerance, by method."""
    state = F.col("pair_state")
    return comparison.groupBy("method").agg(
        F.count_if(
            state.isin("compared", "moved")
        ).alias("compared_count"), F.count_if(state == "absent").alias("absent_count"), F.count_if(state == "extra").alias("extra_count"),
        F.max("absolute_difference").alias("max_difference"), F.bool_and("within_tolerance").alias("reproduced"),
    )


def first_items(scores: DataFrame, n: int = 10) -> DataFrame:
    """The first n items of each method by id."""
    return scores.withColumn(
        "item_order", F.row_number().over(Window.partitionBy("method").orderBy("item"))
    ).where(F.col("item_order") <= n).withColumn("item_order", F.col("item_order").cast("long"))


#: Ranges of hashes in which two tables are compared before any of their rows are.
RANGES = 4096


def _ranged(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with two hashes, which tell a null from anything, and the range of the first."""
    whole = [F.to_json(c) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in columns]
    states = [F.col(c).isNull() for c in columns]
    hashed = df.withColumn("__sg_h", F.xxhash64(*whole, *states)).withColumn("__sg_g", F.xxhash64(F.lit("second"), *whole, *states))
    return hashed.withColumn("__sg_range", F.pmod("__sg_h", F.lit(RANGES)))


def only_differing(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of both tables (with the columns of the first) that lie in ranges of hashes whose count or sums of hashes differ, and these
    ranges. Equal tables are compared by a few sums each, and no row of a range that agrees is shuffled; repeated rows count."""
    columns = a.columns
    left, right = (_ranged(df.select(*columns), columns) for df in (a, b))
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    sums = [
        df.groupBy("__sg_range").agg(
            F.count(F.lit(1)).alias(f"n{k}"), wide("__sg_h").alias(f"h{k}"), wide("__sg_g").alias(f"g{k}")
        )
        for k, df in enumerate((left, right))
    ]
    both = sums[0].join(sums[1], "__sg_range", "full_outer")
    same = F.col("n0").eqNullSafe(F.col("n1")) & F.col("h0").eqNullSafe(F.col("h1")) & F.col("g0").eqNullSafe(F.col("g1"))
    moved = staged(both.where(~same).select("__sg_range"))
    own = lambda df: df.join(F.broadcast(moved), "__sg_range", "left_semi").select(*columns)
    return own(left), own(right), moved


def recomputed_violations(stored: DataFrame, fresh: DataFrame, table: str) -> DataFrame:
    """Rows of a stored table that a recomputation doesn't give, and the other way round: table, side, row (as JSON). Only ranges of
    hashes that differ are compared row by row."""
    text = F.to_json(F.struct(*sorted(stored.columns)), {"ignoreNullFields": "false"})
    stored, fresh, _ = only_differing(stored, fresh)
    gone, new = stored.exceptAll(fresh), fresh.exceptAll(stored)
    return gone.select(F.lit(table).alias("table_name"), F.lit("stored_only").alias("side"), text.alias("row_json")).unionByName(
        new.select(F.lit(table).alias("table_name"), F.lit("fresh_only").alias("side"), text.alias("row_json"))
    )


def recomputed_all(stored: dict[str, DataFrame], fresh: dict[str, DataFrame]) -> DataFrame:
    """recomputed_violations over all tables of an evaluation; a table that one side lacks is an error."""
    if stored.keys() != fresh.keys():
        raise ValueError(f"tables {sorted(stored)} and {sorted(fresh)}")
    return reduce(DataFrame.unionByName, [recomputed_violations(stored[t], fresh[t], t) for t in stored])


def evaluation_tables(
    calibration: DataFrame,
    scores: DataFrame,
    labels: DataFrame,
    quantile: float = 0.95,
    facts: DataFrame | None = None,
    evidence: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Every table of an evaluation worked out from its scores and labels: thresholds, classes, reveal, metrics, cases, decision.

    facts: p95_duration, reference_count, anomaly_training_labels and reproduced of each method; evidence: as evaluation.decide has it.
    A method without facts fails its gates, one without evidence is rejected for that."""
    cuts = staged(S.thresholds(calibration, quantile))
    classes = staged(S.classify(scores, cuts))
    shown = staged(ev.reveal(classes, labels))
    metrics = staged(ev.confusion(shown))
    asked = ("p95_duration", "reference_count", "anomaly_training_labels", "reproduced")
    own = metrics.select("method", "fpr", "recall")
    measured = null_safe_join(
        own, facts.select("method", *asked), ["method"], "left"
    ) if facts is not None else own.withColumns({c: F.lit(None).cast("double") for c in asked})
    if evidence is None:
        evidence = metrics.select(
            "method",
            *(F.lit(False).alias(c) for c in ("leakage", "contradicted", "guardrail")),
            F.lit(None).cast("string").alias("condition")
        )
    return {
        "thresholds": cuts,
        "classes": classes,
        "reveal": shown,
        "metrics": metrics,
        "cases": staged(ev.error_cases(shown)),
        "decision": staged(ev.decide(ev.gates(measured), evidence))
    }


def stage_facts(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """One row for stage_guard: rows of both sides and whether their contents have one digest, whatever their order."""
    a, b = (
        content_digest(df, []).select(F.coalesce("line_count", F.lit(0)).alias("n"), F.coalesce("digest", F.lit("")).alias("d"))
        for df in (expected, observed)
    )
    both = a.select(F.col("n").alias("expected_count"), F.col("d").alias("__sg_a")).join(
        b.select(F.col("n").alias("observed_count"), F.col("d").alias("__sg_b")), F.lit(True)
    )
    return both.select("expected_count", "observed_count", (F.col("__sg_a") == F.col("__sg_b")).alias("digests_agree"))


def label_free_summary(scores: DataFrame, classified: DataFrame, passes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Eleven aggregates of each method over scores, their classifications and their timed passes, without any label. A score without
    its classification, a classification without its score and a pass of an item without score make the agreement false."""
    states = lambda df, prefix, *more: df.select("method", "item", *more, F.lit(True).alias(f"{prefix}seen"), *(F.col(c).alias(f"{prefix}{c}") for c in ("score", "score_status", "failure_code")))
    own = scores.withColumn("__sg_own", F.lit(True))
    decided = null_safe_join(own, states(classified, "__sg_c_", "is_anomalous"), ["method", "item"], "full_outer")
    agrees = lambda p: (F.col("score_status") == F.col(f"{p}score_status")) & F.col("failure_code").eqNullSafe(F.col(f"{p}failure_code"))
    same = F.coalesce((F.col("score") == F.col("__sg_c_score")) & agrees("__sg_c_"), F.lit(False))
    one = decided.groupBy("method").agg(
        F.count("__sg_own").alias("item_count"), F.count_if(F.col("score_status") == "ok").alias("ok_count"), F.count_if(
            F.col("score_status") == "failed"
        ).alias("failed_count"),
        F.count_if("is_anomalous").alias("anomalous_count"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.bool_and(same).alias(
            "classification_agrees"
        ),
    )
    timed = null_safe_join(
        states(passes, "__sg_p_", "duration"),
        scores.select("method", "item", "score", "score_status", "failure_code"),
        ["method", "item"],
        "left"
    )
    away = F.abs(F.col("score") - F.col("__sg_p_score"))
    stable = F.coalesce((away <= tolerance) & agrees("__sg_p_"), F.lit(False))
    two = timed.groupBy("method").agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.max(away).alias("max_pass_difference"),
        F.bool_and(stable).alias("passes_agree")
    )
    three = median_and_more(passes, ["method"], "duration", median="median_duration")
    return null_safe_join(null_safe_join(one, two, ["method"], "full_outer"), three, ["method"], "left")


def stage_guard(stages: DataFrame) -> DataFrame:
    """Stages (stage_order, expected_count, observed_count, digests_agree): done, due or out of order; a stage with rows after one
    without ran too early."""
    gap = F.min(F.when(F.col("observed_count") == 0, F.col("stage_order"))).over(Window.partitionBy())
    state = F.when(
        (F.col("observed_count") > 0) & (F.col("stage_order") > gap), "ran_early"
    ).when(F.col("observed_count") == 0, "due").when(
        (F.col("observed_count") != F.col("expected_count")) | ~F.col("digests_agree"), "disagrees"
    ).otherwise("done")
    return stages.withColumn("stage_state", state)

"""Table contracts as violation tables: an empty table means that the input is valid.

A column contract says kind, whether null is allowed, fixed or listed values and bounds; the closed set of columns is
checked before any row is read. Rows of violations are (rule, row_key, detail).

Defined cases: a null in a rule's columns breaks the rule unless it says otherwise, so that nulls can't pass for agreement;
repeated rows are reported as often as they stand; empty tables break no row rule, only collection_violations asks for rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from scoregate.functions import scalars as S
from scoregate.operators.evaluation import latency
from scoregate.operators.prefix import null_safe_join, ordinals
from scoregate.operators.reproduce import agreement, only_differing
from scoregate.operators.scores import verdicts


@dataclass(frozen=True)
class Field:
    name: str
    nullable: bool = False
    kind: str | None = None
    fixed: object = None
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    pattern: str | None = None


class ContractError(ValueError):
    """The columns of a table can't be what the contract says."""


def require_columns(df: DataFrame, allowed: list[str], protected: tuple[str, ...] = ()) -> DataFrame:
    """df if it has exactly the allowed columns and none that is protected (labels and what they are made of)."""
    found = {c.lower() for c in df.columns}
    leaked = found & {p.lower() for p in protected}
    if leaked:
        raise ContractError(f"protected columns: {sorted(leaked)}")
    if found != {a.lower() for a in allowed}:
        raise ContractError(f"columns {sorted(found)}, expected {sorted(allowed)}")
    return df


def row_violations(df: DataFrame, fields: list[Field], key: str) -> DataFrame:
    """One row for each rule that a row breaks."""
    rules: list[Column] = []
    for f in fields:
        c = F.col(f.name)
        checks = [] if f.nullable else [(c.isNull(), "null")]
        if f.kind:  # a text that must read as this type
            checks.append((c.isNotNull() & F.expr(f"try_cast(`{f.name}` as {f.kind})").isNull(), "not_a_" + f.kind))
        if f.fixed is not None:
            checks.append((c != F.lit(f.fixed), "changed"))
        if f.values:
            checks.append((~c.isin(*f.values), "not_allowed"))
        if f.low is not None:
            checks.append((c < f.low, "below_minimum"))
        if f.high is not None:
            checks.append((c > f.high, "above_maximum"))
        if f.pattern:
            checks.append((~c.rlike(f.pattern), "malformed"))
        rules += [F.when(bad, F.struct(F.lit(f"{f.name}:{what}").alias("rule"), c.cast("string").alias("detail"))) for bad, what in checks]
    broken = df.select(F.col(key).cast("string").alias("row_key"), F.explode(F.array_compact(F.array(*rules))).alias("v"))
    return broken.select("v.rule", "row_key", "v.detail")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def contiguity(df: DataFrame, groups: list[str], index: str, start: int = 0) -> DataFrame:
    """Whether each group's index runs from start without a gap or repeat."""
    n = F.count(F.lit(1))
    return df.groupBy(*groups).agg(
        n.alias("row_count"),
        F.coalesce(
            (F.min(index) == start) & (F.max(index) == start + n - 1) & (F.count_distinct(index) == n), F.lit(False)
        ).alias("contiguous")
    )


def single_valued(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values each column has, one row, with whether all have exactly one."""
    out = df.agg(*(F.count_distinct(c).alias(f"{c}_values") for c in columns))
    one = F.lit(True)
    for c in columns:
        one = one & (F.col(f"{c}_values") == 1)
    return out.withColumn("single_run", one)


def canonical_order(rows: DataFrame, methods: list[str], keys: list[str]) -> list[Column]:
    """The order of a contract's rows at its sink: the method's place in the inventory, then the keys (pass before item, case type
    before rank), nulls and unknown methods first."""
    place = [F.array_position(F.array(*map(F.lit, methods)), F.col("method"))] if "method" in rows.columns else []
    return [*place, *map(F.col, keys)]


def order_violations(rows: DataFrame, position: str, methods: list[str], keys: list[str]) -> DataFrame:
    """Rows whose stored position (from 0) isn't their place in the canonical order, with that place: the row's columns and place."""
    names = [f"__sg_k{i}" for i in range(len(canonical_order(rows, methods, keys)))]
    keyed = rows.withColumns(dict(zip(names, canonical_order(rows, methods, keys), strict=True)))
    placed = ordinals(keyed.withColumn("__sg_one", F.lit(0)), ["__sg_one"], names, "__sg_place").withColumn("place", F.col("__sg_place") - 1)
    return placed.drop("__sg_one", "__sg_place", *names).where(~F.col("place").eqNullSafe(F.col(position)))


def collection_violations(rows: DataFrame, primary_key: list[str], run: list[str], groups: list[str], index: str, exactly: int | None = None) -> DataFrame:
    """What a collection breaks as a whole (rule, group_key, row_count): empty, mixed_runs, duplicate_key, gap (an index of a group
    that doesn't run from 0 without gap or repeat) and wrong_count where each group has `exactly` so many rows."""
    say = lambda df, rule, key, n: df.select(F.lit(rule).alias("rule"), key.cast("string").alias("group_key"), n.cast("long").alias("row_count"))
    joined = lambda names: F.concat_ws("|", *(F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in names)) if names else F.lit("all")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*run)).alias("runs"))
    out = say(whole.where("n = 0"), "empty", F.lit("all"), F.col("n")).unionByName(say(whole.where("runs > 1"), "mixed_runs", F.lit("all"), F.col("runs")))
    out = out.unionByName(say(key_violations(rows, primary_key), "duplicate_key", joined(primary_key), F.col("row_count")))
    held = contiguity(rows, groups, index)
    out = out.unionByName(say(held.where(~F.coalesce("contiguous", F.lit(False))), "gap", joined(groups), F.col("row_count")))
    if exactly is not None:
        out = out.unionByName(say(held.where(F.col("row_count") != exactly), "wrong_count", joined(groups), F.col("row_count")))
    return out


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def semantic_violations(classified: DataFrame) -> DataFrame:
    """Rows whose flag, class, reason or margin contradict score and threshold: (method, item, rule), a row for each rule."""
    want = verdicts()
    return _broken(classified, ["method", "item"], (
        (_differs(F.col("score_margin"), want["score_margin"]), "margin"),
        (_differs(F.col("is_anomalous"), want["is_anomalous"]), "flag"),
        (_differs(F.col("predicted_class"), F.when(F.col("is_anomalous"), "anomaly").otherwise("normal")), "class"),
        (_differs(F.col("decision_reason"), want["decision_reason"]), "reason"),
    ))


def _broken(rows: DataFrame, keys: list[str], rules: tuple[tuple[Column, str], ...]) -> DataFrame:
    """A row of keys and rule for each rule that a row breaks."""
    return rows.select(*keys, F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in rules)))).alias("rule"))


def duration_violations(observations: DataFrame, with_adapter: tuple[str, ...]) -> DataFrame:
    """Observations whose duration isn't adapter plus scorer time, or that have an adapter time without an adapter: (method, item,
    pass_index, rule)."""
    own = F.coalesce(F.col("method").isin(*with_adapter), F.lit(False))
    total = F.when(own, F.col("adapter_duration") + F.col("scorer_duration")).otherwise(F.col("scorer_duration"))
    return _broken(observations, ["method", "item", "pass_index"], (
        (own & F.col("adapter_duration").isNull(), "adapter_missing"),
        (~own & F.col("adapter_duration").isNotNull(), "adapter_forbidden"),
        (_differs(F.col("duration"), total), "duration_sum"),
    ))


def reproduction_violations(comparison: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows of a stored comparison (reproduce.compared) whose difference or verdict isn't what its scores say: (method, item, rule)."""
    difference, agrees = agreement(tolerance)
    return _broken(comparison, ["method", "item"], (
        (_differs(F.col("absolute_difference"), difference), "difference"),
        (_differs(F.col("within_tolerance"), agrees), "tolerance"),
    ))


def case_violations(cases: DataFrame) -> DataFrame:
    """Error cases whose classes or margin contradict their type: (method, item, rule)."""
    positive = F.col("case_type") == "false_positive"
    return _broken(cases, ["method", "item"], (
        (_differs(F.col("score_margin"), F.col("score") - F.col("threshold")), "margin"),
        (F.coalesce(~F.col("case_type").isin("false_positive", "false_negative"), F.lit(True)), "case_type"),
        (_differs(F.col("true_class"), F.when(positive, "normal").otherwise("anomaly")), "true_class"),
        (_differs(F.col("predicted_class"), F.when(positive, "anomaly").otherwise("normal")), "predicted_class"),
    ))


def summary_violations(metrics: DataFrame) -> DataFrame:
    """Methods whose counts, rates, stored class support (metrics_status) or p95 rank contradict one another: (method, rule), a row for
    each rule."""
    pos, neg = F.col("true_positive") + F.col("false_negative"), F.col("true_negative") + F.col("false_positive")
    away = lambda stored, k, n: F.when(n > 0, F.coalesce(F.abs(stored - k / n) > 1e-12, F.lit(True))).otherwise(stored.isNotNull())
    return _broken(metrics, ["method"], (
        (_differs(pos + neg, F.col("item_count")), "counts"),
        (away(F.col("fpr"), F.col("false_positive"), neg), "fpr"),
        (away(F.col("recall"), F.col("true_positive"), pos), "recall"),
        (F.coalesce(F.col("score_failures") > F.col("true_positive") + F.col("false_positive"), F.lit(True)), "failures_not_anomalous"),
        *(
            (
                (
                    _differs(
                        F.col("metrics_status"), F.when((pos > 0) & (neg > 0), "ok").otherwise("METRICS_CLASS_SUPPORT_INVALID")
                    ),
                    "class_support"
                ),
            )
            if "metrics_status" in metrics.columns
            else ()
        ),
        *(((_differs(F.col("p95_rank"), F.ceil(F.lit(0.95) * F.col("observation_count"))), "rank"),) if "p95_rank" in metrics.columns else ()),
    ))


def decision_violations(decided: DataFrame, gated: DataFrame) -> DataFrame:
    """Methods whose stored decision isn't what their gates (evaluation.short_circuit) and evidence say: (method, rule)."""
    first = gated.groupBy("method").agg(
        F.min(F.when(~F.col("passed"), F.struct("gate_order", "gate")))["gate"].alias("__sg_first"),
        F.count_if(
            _differs(
                F.col("gate_status"),
                F.when(
                    F.col("first_failed_order").isNull() | (F.col("gate_order") < F.col("first_failed_order")), "pass"
                ).when(F.col("gate_order") == F.col("first_failed_order"), "fail").otherwise("not_evaluated")
            )
        ).alias("__sg_states"),
        F.lit(True).alias("__sg_seen"),
    )
    joined = null_safe_join(decided, first, ["method"], "left")
    rejected = F.col("__sg_first").isNotNull() | ~F.coalesce(
        F.col("evidence_valid"), F.lit(False)
    ) | F.coalesce(F.col("leakage"), F.lit(True)) | F.coalesce(F.col("contradicted"), F.lit(True))
    want = F.when(rejected, "REJECT").when(F.col("guardrail"), "ADOPT WITH CONDITIONS").otherwise("ADOPT")
    return _broken(joined, ["method"], (
        (F.col("__sg_seen").isNull(), "gates_missing"),
        (F.col("__sg_states") > 0, "gate_states"),
        (_differs(F.col("first_failed_gate"), F.col("__sg_first")), "first_failed_gate"),
        (_differs(F.col("decision"), want), "decision"),
        ((want == "ADOPT WITH CONDITIONS") & F.col("condition").isNull(), "condition_missing"),
        ((want != "ADOPT WITH CONDITIONS") & F.col("condition").isNotNull(), "condition_without_guardrail"),
    ))


def latency_violations(observations: DataFrame, summary: DataFrame, passes: int, tolerance: float = 1e-9) -> DataFrame:
    """What a table of timed passes and its stored summary break: (method, rule): pass_set (not the passes 0 to passes - 1), item_set
    (a pass without some item of the method), repeated (an item twice in a pass), status (an item ok in one pass and failed in
    another) and summary (a stored count, median, p95 or rank that isn't the recomputed one)."""
    n = F.count(F.lit(1))
    by_item = observations.groupBy("method", "item").agg(
        n.alias("n"),
        F.count_distinct("pass_index").alias("passes"),
        F.min("pass_index").alias("low"),
        F.max("pass_index").alias("high"),
        F.count_distinct("score_status").alias("states")
    )
    shape = by_item.groupBy("method").agg(
        F.count_if((F.col("low") < 0) | (F.col("high") >= passes)).alias("outside"), F.count_if(F.col("passes") != passes).alias("short"),
        F.count_if(F.col("n") != F.col("passes")).alias("twice"), F.count_if(F.col("states") != 1).alias("mixed"),
    )
    out = _broken(
        shape,
        ["method"],
        (
            (F.col("outside") > 0, "pass_set"),
            (F.col("short") > 0, "item_set"),
            (F.col("twice") > 0, "repeated"),
            (F.col("mixed") > 0, "status")
        )
    )
    facts = ("observation_count", "failed_count", "median_duration", "p95_duration", "p95_rank")
    fresh = latency(observations, ["method"]).select("method", *(F.col(c).alias(f"__sg_{c}") for c in facts), F.lit(True).alias("__sg_seen"))
    both = null_safe_join(summary.select("method", *facts), fresh, ["method"], "full_outer")
    near = F.lit(True)
    for c in facts:
        near = near & (F.col(c).eqNullSafe(F.col(f"__sg_{c}")) | F.coalesce(F.abs(F.col(c) - F.col(f"__sg_{c}")) <= tolerance, F.lit(False)))
    return out.unionByName(both.where(~near).select("method", F.lit("summary").alias("rule")))


def manifest_report(manifest: DataFrame, fresh: DataFrame, counts: DataFrame, strict: bool = True) -> DataFrame:
    """Everything that is wrong with a manifest in one table (rule, key): the rules of its rows, records in two partitions or twice
    in one, partitions whose size isn't the contract's (counts: partition, expected_count), digests that aren't SHA-256, and rows
    that a fresh selection doesn't give or that it gives besides."""
    out = manifest_violations(manifest, strict).select("rule", F.col("record_id").alias("key"))
    twice = manifest.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("partition").alias("p")).where("n > 1")
    out = out.unionByName(
        twice.select(
            F.when(F.col("p") > 1, "partitions_overlap").otherwise("duplicate_record").alias("rule"),
            F.col("record_id").alias("key")
        )
    )
    sizes = null_safe_join(manifest.groupBy("partition").agg(F.count(F.lit(1)).alias("n")), counts, ["partition"], "full_outer")
    out = out.unionByName(
        sizes.where(_differs(F.col("n"), F.col("expected_count"))).select(
            F.lit("partition_count").alias("rule"), F.col("partition").alias("key")
        )
    )
    if "content_sha256" in manifest.columns:
        out = out.unionByName(
            manifest.where(~F.coalesce(F.col("content_sha256").rlike(S.SHA256), F.lit(False))).select(
                F.lit("digest_malformed").alias("rule"), F.col("record_id").alias("key")
            )
        )
    same = ["record_id", "partition", "selection_rank"]
    stored, again, _ = only_differing(manifest.where(F.col("partition") != "final-test").select(*same), fresh.select(*same))
    gone, new = stored.exceptAll(again), again.exceptAll(stored)
    return out.unionByName(
        gone.select(F.lit("not_in_selection").alias("rule"), F.col("record_id").alias("key"))
    ).unionByName(new.select(F.lit("not_in_manifest").alias("rule"), F.col("record_id").alias("key")))


def sealed_violations(mapping: DataFrame, source: str = "source_path", label: str = "class_label") -> DataFrame:
    """What a sealed mapping (asset_id, source path, class label) breaks: (rule, key), a row for each: ids that aren't `asset-` and at least six
    digits in their one form, ids and paths met twice, numbers that don't run from 0 (asset_gap), unsafe paths, empty classes, no rows."""
    say = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))
    number = S.asset_index(F.col("asset_id"))
    rules = (
        (~F.col("asset_id").eqNullSafe(S.asset_id(number)), "asset_malformed"),
        (~S.safe_relative_path(F.col(source), True), "unsafe_path"),
        (F.coalesce(F.trim(label) == "", F.lit(True)), "class_missing"),
    )
    out = mapping.select(F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in rules)))).alias("rule"), F.col("asset_id").alias("key"))
    for column, rule in (("asset_id", "asset_repeated"), (source, "path_repeated")):
        out = out.unionByName(say(key_violations(mapping.where(F.col(column).isNotNull()), [column]), rule, F.col(column)))
    numbers = mapping.select(number.alias("n")).where("n is not null").distinct().agg(
        F.count("n").alias("count"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    out = out.unionByName(say(numbers.where("count > 0 and (low <> 0 or high <> count - 1)"), "asset_gap", F.col("high")))
    return out.unionByName(say(mapping.agg(F.count(F.lit(1)).alias("count")).where("count = 0"), "empty", F.col("count")))


def with_partition_labels(rows: DataFrame, label: str = "label", partition: str = "partition", hidden: tuple[str, ...] = ("final-test",)) -> DataFrame:
    """The rows with their label where their partition may show it, and null where it is hidden; a row without a partition shows none.
    Written as JSON without nulls, hidden labels leave no trace."""
    shown = F.coalesce(~F.col(partition).isin(*hidden), F.lit(False))
    return rows.withColumn(label, F.when(shown, F.col(label)))


def split_violations(rows: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Rows of a split table that break its rules: training rows are normal, test rows normal or anomalies, and no other split is
    there. The rows with the column rule."""
    rule = S.any_code(
        (F.col(split).isNull() | ~F.col(split).isin("train", "test"), "unknown_split"),
        ((F.col(split) == "train") & ~F.col(label).eqNullSafe(F.lit("normal")), "train_not_normal"),
        ((F.col(split) == "test") & ~F.coalesce(F.col(label).isin("normal", "anomaly"), F.lit(False)), "test_label_unknown"),
    )
    return rows.withColumn("rule", rule).where("rule is not null")


def manifest_violations(manifest: DataFrame, strict: bool = True) -> DataFrame:
    """Manifest rows (record_id, partition, category, relative_path, label, selection_rank) that break a rule."""
    normal = F.col("partition") != "final-test"
    rule = S.any_code(
        (~S.safe_relative_path(F.col("relative_path"), strict), "unsafe_path"),
        (~F.col("record_id").eqNullSafe(S.record_id(F.col("category"), F.col("relative_path"))), "record_id"),
        (normal & F.col("selection_rank").isNull(), "rank_missing"),
        (~normal & (F.col("label").isNotNull() | F.col("selection_rank").isNotNull()), "label_leak"),
    )
    return manifest.select("record_id", rule.alias("rule")).where("rule is not null")

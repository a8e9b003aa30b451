"""Queries over vectors: bank building, nearest-neighbour, z-score and template scores, and the flagship decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoregate.functions import scalars as S
from scoregate.operators import evaluation as ev, hooks, partition, pivots, reproduce, scores as sc, vectors as v
from scoregate.plans import inputs as I
from scoregate.plans.registry import query
from scoregate.sources.stages import staged

SIZE = 8

PARTS_SQL = """h AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sha256('scoregate:42:' || vec_id) AS d FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS k FROM h),
parts AS (SELECT vec_id, label, e, k, d, CASE WHEN label <> 0 THEN 'final-test' WHEN k <= 20 THEN 'reference'
    WHEN k % 2 = 1 THEN 'calibration' ELSE 'final-test' END AS part FROM r),
cut AS (SELECT vec_id, label, part, i::INT AS position, e[i * 8 + 1:i * 8 + 8] AS p FROM parts, range(8) t(i)),
u AS (SELECT *, list_transform(p, lambda x: x / greatest(sqrt(list_dot_product(p, p)), 1e-12)) AS q FROM cut)"""


def parted(spark, sf_dir):
    """Embeddings with partition: 20 references of label 0, of its other rows odd ranks calibration, all else final test. Written
    once, as references, calibration and final test all read it; a query that needs it twice passes it on."""
    rows = I.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    ranked = partition.seeded_partitions(rows, I.NAMESPACE, I.SEED, 20, "label", "vec_id")
    part = F.when(F.col("label") != 0, "final-test").when(F.col("selection_rank") <= 20, "reference").when(
        F.col("selection_rank") % 2 == 1, "calibration"
    ).otherwise("final-test")
    return staged(ranked.select("vec_id", "label", "embedding", part.alias("part"), "selection_rank"))


def patched(rows, part):
    return v.patches(rows.where(F.col("part").isin(*part)), "vec_id", "embedding", SIZE)


NN_SQL = f"""{PARTS_SQL}, b AS (SELECT q FROM u WHERE part = 'reference'),
dist AS (SELECT u.vec_id, u.label, u.part, u.position, min(least(greatest(1 - list_dot_product(u.q, b.q), 0), 2)) AS distance
    FROM u, b WHERE part <> 'reference' GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance DESC, position) AS patch_rank FROM dist),
item AS (SELECT vec_id AS item, label, part, round(avg(distance), 9) AS score FROM top WHERE patch_rank <= 2 GROUP BY ALL)"""


def distances(rows, asked=None):
    """Distances of the rows outside the references (or of some of them) to the bank of the references."""
    asked = rows if asked is None else asked
    return v.nearest_distances(patched(asked, ["calibration", "final-test"]), "vec_id", v.bank(patched(rows, ["reference"])))


def nn_scores(rows, asked=None):
    s = v.item_scores(distances(rows, asked), "vec_id", "distance", 0.25, "ceil")
    return s.select(
        F.lit("bank_nn").alias("method"),
        F.col("vec_id").alias("item"),
        F.lit("ok").alias("score_status"),
        F.lit(None).cast("string").alias("failure_code"),
        F.round("score", 9).alias("score")
    )


@query("large_bank_distances", f"""WITH {PARTS_SQL} SELECT a.vec_id, a.position,
    round(min(least(greatest(1 - list_dot_product(a.q, b.q), 0), 2)), 9) AS distance
FROM u a, u b WHERE a.part = 'calibration' AND b.part <> 'calibration' GROUP BY ALL""")
def large_bank_distances(spark, sf_dir):
    """Calibration patches against a bank of all others, by pivots whatever its size."""
    rows = parted(spark, sf_dir)
    found = pivots.nearest_in_bank(patched(rows, ["calibration"]), "vec_id", patched(rows, ["reference", "final-test"]))
    return found.select("vec_id", "position", F.round("distance", 9).alias("distance"))


@query("bank_selection", f"WITH {PARTS_SQL} SELECT vec_id, d AS selection_sha256 FROM parts WHERE part = 'reference'")
def bank_selection(spark, sf_dir):
    rows = I.table(spark, sf_dir, "embeddings").where("label = 0")
    return partition.first_by_digest(rows, I.NAMESPACE, I.SEED, "vec_id", 20).select("vec_id", "selection_sha256")


@query("bank_unit_vectors", f"WITH {PARTS_SQL} SELECT vec_id, position, round(list_sum(q), 9) AS patch_sum, true AS unit_norm FROM u WHERE part = 'reference'")
def bank_unit_vectors(spark, sf_dir):
    p = patched(parted(spark, sf_dir), ["reference"]).withColumn("patch", S.unit(F.col("patch")))
    total = F.aggregate("patch", F.lit(0.0), lambda s, x: s + x)
    return p.select("vec_id", "position", F.round(total, 9).alias("patch_sum"), (F.abs(S.dot(F.col("patch"), F.col("patch")) - 1) < 1e-9).alias("unit_norm"))


@query("nearest_neighbour_distances", f"WITH {NN_SQL} SELECT vec_id, position, round(distance, 9) AS distance FROM dist")
def nearest_neighbour_distances(spark, sf_dir):
    return distances(parted(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


@query("nearest_neighbour_scores", f"WITH {NN_SQL} SELECT item, score FROM item")
def nearest_neighbour_scores(spark, sf_dir):
    return nn_scores(parted(spark, sf_dir)).select("item", "score")


@query("top_patches", f"WITH {NN_SQL} SELECT vec_id, position, patch_rank, round(distance, 9) AS distance FROM top WHERE patch_rank <= 3")
def top_patches(spark, sf_dir):
    return v.top_patches(distances(parted(spark, sf_dir)), "vec_id", "distance", 3).select(
        "vec_id", "position", "patch_rank", F.round("distance", 9).alias("distance")
    )


@query("top_fraction_rounding", """WITH a AS (SELECT vec_id, list_reverse_sort(embedding::DOUBLE[]) AS e, len(embedding) AS n FROM embeddings)
SELECT vec_id, round(list_sum(e[1:greatest(1, ceil(0.07::DOUBLE * n))::INT]) / greatest(1, ceil(0.07::DOUBLE * n)),
    9) AS ceil_mean, round(list_sum(e[1:greatest(1, floor(0.07::DOUBLE * n))::INT]) / greatest(1, floor(0.07::DOUBLE * n)), 9) AS floor_mean FROM a""")
def top_fraction_rounding(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    return I.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(S.top_fraction_mean(e, 0.07, "ceil"), 9).alias("ceil_mean"),
        F.round(S.top_fraction_mean(e, 0.07, "floor"), 9).alias("floor_mean")
    )


ZSCORE_SQL = f"""{PARTS_SQL}, flat AS (SELECT vec_id, label, part, position, j - 1 AS dim, p[j] AS x FROM cut, range(1, 9) t(j)),
fit AS (SELECT position, dim, avg(x) AS mean, stddev_pop(x) AS deviation, CASE WHEN stddev_pop(x) = 0 THEN 1
    ELSE stddev_pop(x) END AS scale FROM flat WHERE part = 'reference' GROUP BY ALL)"""


@query(
    "position_scalers",
    f"WITH {ZSCORE_SQL} SELECT position, dim::INT AS dim, round(mean, 7) AS mean, round(deviation, 7) AS deviation, round(scale, 7) AS scale FROM fit"
)
def position_scalers(spark, sf_dir):
    return v.position_scalers(patched(parted(spark, sf_dir), ["reference"])).withColumns({c: F.round(c, 7) for c in ("mean", "deviation", "scale")})


@query("position_zscore_scores", f"""WITH {ZSCORE_SQL}, z AS (SELECT vec_id, f.position,
    sum(((x - mean) / scale) * ((x - mean) / scale)) / 8 AS distance FROM flat f JOIN fit USING (position, dim) WHERE part <> 'reference' GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance DESC) AS k FROM z) SELECT vec_id, round(distance, 6) AS score FROM t WHERE k = 1""")
def position_zscore_scores(spark, sf_dir, rows=None):
    rows = rows or parted(spark, sf_dir)
    scalers = v.position_scalers(patched(rows, ["reference"]))
    z = v.position_zscores(patched(rows, ["calibration", "final-test"]), "vec_id", scalers)
    return v.item_scores(z, "vec_id", "distance", 0.05, "ceil").withColumn("score", F.round("score", 6))


TEMPLATE_SQL = f"""{PARTS_SQL}, el AS (SELECT vec_id, part, j - 1 AS dim, e[j] AS x FROM parts, range(1, 65) t(j)),
tpl AS (SELECT dim, median(x) AS median FROM el WHERE part = 'reference' GROUP BY dim)"""


@query(
    "median_template",
    f"WITH {TEMPLATE_SQL} SELECT dim::INT AS dim, round(median, 9) AS median, true AS supported, 1.0::DOUBLE AS support_share, true AS template_ok FROM tpl"
)
def median_template(spark, sf_dir):
    t = v.median_template(parted(spark, sf_dir).where("part = 'reference'"), "embedding")
    return t.withColumn("median", F.round("median", 9))


@query("template_residual_scores", f"""WITH {TEMPLATE_SQL}, res AS (SELECT vec_id, abs(x - median) AS a,
    row_number() OVER (PARTITION BY vec_id ORDER BY abs(x - median) DESC) AS k FROM el JOIN tpl USING (dim) WHERE part <> 'reference')
SELECT vec_id, 1.0::DOUBLE AS support_ratio, 'ok' AS score_status, round(avg(a), 9) AS score FROM res WHERE k <= 4 GROUP BY vec_id""")
def template_residual_scores(spark, sf_dir, rows=None):
    rows = rows or parted(spark, sf_dir)
    template = v.median_template(rows.where("part = 'reference'"), "embedding")
    out = v.template_residuals(rows.where("part <> 'reference'"), "vec_id", "embedding", template, fraction=0.05)
    return out.select("vec_id", "support_ratio", "score_status", F.round("score", 9).alias("score"))


@query("tile_grid", """SELECT vec_id, a AS tile_row, b AS tile_col, round(list_sum(list_transform(range(0, 16),
    lambda k: e[((a * 2 + k // 4) * 8 + b * 2 + k % 4 + 1)::INT])), 7) AS tile_sum
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), (SELECT i::INT AS a FROM range(3) r(i)), (SELECT i::INT AS b FROM range(3) r(i))""")
def tile_grid(spark, sf_dir):
    rows = I.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    t = v.tiles(rows, "vec_id", "embedding", 8, 8, (4, 4), (2, 2))
    return t.select("vec_id", "tile_row", "tile_col", F.round(F.aggregate("tile", F.lit(0.0), lambda s, x: s + x), 7).alias("tile_sum"))


METHOD_SQL = f"""{NN_SQL}, c AS (SELECT score, row_number() OVER (ORDER BY score, item) AS k, count(*) OVER () AS n FROM item WHERE part = 'calibration'),
thr AS (SELECT score AS threshold FROM c WHERE k = ceil(0.95::DOUBLE * n::DOUBLE)),
rev AS (SELECT item, score, score > threshold AS said, label <> 0 AS anomaly FROM item, thr WHERE part = 'final-test'),
conf AS (SELECT count(*) FILTER (WHERE said AND anomaly) AS tp, count(*) FILTER (WHERE NOT said
    AND anomaly) AS fn, count(*) FILTER (WHERE NOT said AND NOT anomaly) AS tn, count(*) FILTER (WHERE said AND NOT anomaly) AS fp FROM rev),
st AS (SELECT score, count(*) FILTER (WHERE anomaly) AS pos, count(*) FILTER (WHERE NOT anomaly) AS neg FROM rev GROUP BY score),
cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM st),
rk AS (SELECT round(sum(neg * (cp - pos / 2))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE, 9) AS auroc,
    round(sum(pos * cp / (cp + cn)) / sum(pos), 9) AS average_precision FROM cu),
lat AS (SELECT quantile_disc(value, 0.95) AS p95_duration FROM events)"""


@query("flagship_decision", f"""WITH {METHOD_SQL}
SELECT 'bank_nn' AS method, threshold, tp AS true_positive, fn AS false_negative, tn AS true_negative, fp AS false_positive,
    round(fp / (fp + tn), 9) AS fpr, round(tp / (tp + fn), 9) AS recall, auroc, average_precision, p95_duration,
  CASE WHEN fp / (fp + tn) <= 0.05::DOUBLE AND tp / (tp + fn) >= 0.9::DOUBLE AND p95_duration <= 1.0 THEN 'ADOPT' ELSE 'REJECT' END AS decision,
  CASE WHEN fp / (fp + tn) > 0.05::DOUBLE THEN 'normal_fpr' WHEN tp / (tp + fn) < 0.9::DOUBLE THEN 'anomaly_recall'
    WHEN p95_duration > 1.0 THEN 'cpu_p95' END AS first_failed_gate
FROM thr, conf, rk, lat""")
def flagship_decision(spark, sf_dir):
    """Bank, scores, threshold from normal rows, classes, reveal, metrics and decision: one row."""
    rows = parted(spark, sf_dir)
    # Calibration, classification and metrics all read the scores: they are worked out once.
    s = staged(nn_scores(rows).join(rows.select(F.col("vec_id").alias("item"), "part"), "item"))
    cuts = sc.thresholds(s.where("part = 'calibration'"))
    classes = sc.classify(s.where("part = 'final-test'"), cuts)
    truth = rows.select(F.col("vec_id").alias("item"), F.when(F.col("label") == 0, "normal").otherwise("anomaly").alias("true_class"))
    shown = staged(ev.reveal(classes, truth))
    latency = I.table(spark, sf_dir, "events").select(
        F.lit("bank_nn").alias("method"),
        F.lit("ok").alias("score_status"),
        F.col("user_id").alias("item"),
        F.col("value").alias("duration")
    )
    measured = ev.confusion(shown).join(ev.ranking_quality(shown), "method").join(
        ev.latency(latency, ["method"]).select("method", "p95_duration"), "method"
    ).join(cuts.select("method", "threshold"), "method")
    trained = rows.where("part = 'reference'").agg(
        F.count(F.lit(1)).cast("double").alias("reference_count"),
        F.count_if(F.col("label") != 0).cast("double").alias("anomaly_training_labels")
    )
    # The first ten items are scored again, on their own.
    first = reproduce.first_items(s.where("part = 'final-test'"), 10)
    again = nn_scores(rows, rows.join(F.broadcast(first.select(F.col("item").alias("vec_id"))), "vec_id", "left_semi"))
    repeated = reproduce.reproduction_summary(reproduce.compared(first, again, ["method", "item"])).select(
        "method", F.col("reproduced").cast("double").alias("reproduced")
    )
    facts = measured.join(repeated, "method").join(F.broadcast(trained), F.lit(True))
    evidence = facts.select(
        "method",
        F.lit(False).alias("leakage"),
        F.lit(False).alias("contradicted"),
        F.lit(False).alias("guardrail"),
        F.lit(None).cast("string").alias("condition")
    )
    decided = ev.decide(ev.gates(facts), evidence).select("method", "decision", "first_failed_gate")
    out = measured.join(decided, "method")
    return out.select(
        "method",
        "threshold",
        "true_positive",
        "false_negative",
        "true_negative",
        "false_positive",
        *(F.round(c, 9).alias(c) for c in ("fpr", "recall", "auroc", "average_precision")),
        "p95_duration",
        "decision",
        "first_failed_gate"
    )


@query("vector_method_scores", f"""WITH {NN_SQL},
flat AS (SELECT vec_id, part, position, j - 1 AS dim, p[j] AS x FROM cut, range(1, 9) t(j)), fit AS (SELECT position, dim,
    avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS scale FROM flat WHERE part = 'reference' GROUP BY ALL),
z AS (SELECT vec_id, f.position, sum(((x - mean) / scale) * ((x - mean) / scale)) / 8 AS distance FROM flat f
    JOIN fit USING (position, dim) WHERE part <> 'reference' GROUP BY ALL),
el AS (SELECT vec_id, part, j - 1 AS dim, e[j] AS x FROM parts, range(1, 65) t(j)), tpl AS (SELECT dim, median(x) AS median
    FROM el WHERE part = 'reference' GROUP BY dim),
res AS (SELECT vec_id, abs(x - median) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x - median) DESC) AS k FROM el
    JOIN tpl USING (dim) WHERE part <> 'reference')
SELECT 'bank_nn' AS method, item, score FROM item UNION ALL SELECT 'position_zscore', vec_id, round(max(distance), 6) FROM z
    GROUP BY vec_id UNION ALL SELECT 'template_residual', vec_id, round(avg(a), 9) FROM res WHERE k <= 4 GROUP BY vec_id""")
def vector_method_scores(spark, sf_dir):
    """All three methods over the same items, as one score table."""
    rows, out = parted(spark, sf_dir), None
    own = lambda df: df.select(F.col("vec_id").alias("item"), "score")
    for name, df in (
        ("bank_nn", nn_scores(rows).select("item", "score")),
        ("position_zscore", own(position_zscore_scores(spark, sf_dir, rows))),
        ("template_residual", own(template_residual_scores(spark, sf_dir, rows)))
    ):
        one = df.select(F.lit(name).alias("method"), "item", "score")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "scorer_hook",
    "SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN 'failed' ELSE 'ok' END AS score_status, CASE "
    "WHEN vec_id % 10 = 3 THEN 'SCORER_ERROR:ValueError' END AS failure_code, CASE "
    "WHEN vec_id % 10 <> 3 THEN round(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 9) END AS score FROM embeddings"
)
def scorer_hook(spark, sf_dir):
    """A Python scorer that fails on some rows; they come back as failed rows."""

    def scorer(values):
        if len(values) % 64:
            raise ValueError("wrong length")
        return max(abs(float(x)) for x in values)

    e = F.col("embedding")
    rows = I.table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 3, F.slice(e, 1, 3)).otherwise(e).alias("v"))
    return hooks.score_items(rows, "vec_id", "v", scorer).withColumn("score", F.round("score", 9))


@query(
    "feature_hook",
    "SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN 'EXTRACTOR_ERROR:ValueError' END AS failure_code, CASE "
    "WHEN vec_id % 10 <> 3 THEN round(list_sum(embedding::DOUBLE[]), 6) END AS total, CASE "
    "WHEN vec_id % 10 <> 3 THEN round(list_min(embedding::DOUBLE[]), 9) END AS least FROM embeddings"
)
def feature_hook(spark, sf_dir):
    """Sums and minima by a Python extractor, which fails on empty vectors."""
    e = F.col("embedding")
    rows = I.table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 3, F.slice(e, 1, 0)).otherwise(e).alias("v"))
    out = hooks.extract_features(rows, "vec_id", "v", lambda v: (min(v), sum(float(x) for x in v))[::-1])
    return out.select("vec_id", "failure_code", F.round(F.col("features")[0], 6).alias("total"), F.round(F.col("features")[1], 9).alias("least"))

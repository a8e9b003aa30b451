"""How the library's tables map onto the operators' inputs, in Spark and in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scoregate.sources.stages import staged

NAMESPACE, SEED = "scoregate", 42
METHODS = ("bank_nn", "position_zscore", "template_residual")
#: method, low, high, bounds included, failure score.
RULES = (("bank_nn", 0.0, 2.0, True, 2.0), ("position_zscore", -1e12, 1e12, False, 1e12), ("template_residual", 0.0, 1.0, True, 1.0))
KEY = bytes(range(32))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "method string, low double, high double, inclusive boolean, failure_score double")


RULES_SQL = "rules(method, low, high, inclusive, failure_score) AS (VALUES ('bank_nn', 0.0::DOUBLE, 2.0::DOUBLE, true, 2.0::DOUBLE), ('position_zscore', -1e12::DOUBLE, 1e12::DOUBLE, false, 1e12::DOUBLE), ('template_residual', 0.0::DOUBLE, 1.0::DOUBLE, true, 1.0::DOUBLE))"


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document by every method, from its length; some are missing, as a scorer's failures are."""
    n = F.col("n_chars").cast("double")
    scores = F.array(
        F.struct(F.lit("bank_nn").alias("method"), ((F.col("n_chars") % 2000) / F.lit(1000.0)).alias("score")),
        F.struct(F.lit("position_zscore").alias("method"), (n / F.lit(100.0)).alias("score")),
        F.struct(F.lit("template_residual").alias("method"), ((F.col("n_chars") % 997) / F.lit(997.0)).alias("score"))
    )
    out = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.inline(scores))
    lost = F.col("item") % 97 == 5
    return out.select(
        "method",
        "item",
        F.when(lost, "failed").otherwise("ok").alias("score_status"),
        F.when(lost & (F.col("item") % 2 == 0), "SCORER_ERROR").alias("failure_code"),
        F.when(~lost, F.col("score")).alias("score")
    )


RAW_SQL = """raw AS (
  SELECT method, doc_id AS item, CASE WHEN doc_id % 97 = 5 THEN 'failed' ELSE 'ok' END AS score_status,
    CASE WHEN doc_id % 97 = 5 AND doc_id % 2 = 0 THEN 'SCORER_ERROR' END AS failure_code,
    CASE WHEN doc_id % 97 <> 5 THEN CASE method WHEN 'bank_nn' THEN (n_chars % 2000) / 1000.0::DOUBLE
    WHEN 'position_zscore' THEN n_chars::DOUBLE / 100.0::DOUBLE ELSE (n_chars % 997) / 997.0::DOUBLE END END AS score
  FROM documents, (VALUES ('bank_nn'), ('position_zscore'), ('template_residual')) m(method))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoregate.operators.scores import with_failures

    return with_failures(raw_scores(spark, sf_dir), rules(spark))


SCORES_SQL = f"""{RULES_SQL}, {RAW_SQL},
scores AS (SELECT method, item, score_status, CASE WHEN score IS NULL THEN coalesce(failure_code,
    'SCORE_INVALID') END AS failure_code, coalesce(score, failure_score) AS score FROM raw JOIN rules USING (method))"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true class of the documents that have a label."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item"), F.when(F.col("quality") == 0, "anomaly").otherwise("normal").alias("true_class")
    )


LABELS_SQL = "truth AS (SELECT doc_id AS item, CASE WHEN quality = 0 THEN 'anomaly' ELSE 'normal' END AS true_class FROM labels)"


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the documents without a label, which count as normal."""
    return scores(spark, sf_dir).join(labels(spark, sf_dir), "item", "left_anti")


def final_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the documents with a label, without it."""
    return scores(spark, sf_dir).join(labels(spark, sf_dir), "item", "left_semi")


CALIBRATION_SQL = f"""{SCORES_SQL}, {LABELS_SQL},
calibration AS (SELECT * FROM scores WHERE item NOT IN (SELECT item FROM truth)),
final_test AS (SELECT * FROM scores WHERE item IN (SELECT item FROM truth)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score, item) AS r, count(*) OVER (PARTITION BY method) AS n FROM calibration),
cuts AS (SELECT method, n AS item_count, r AS threshold_rank, score AS threshold, item AS threshold_item FROM ranked
    WHERE r = ceil(0.95::DOUBLE * n::DOUBLE))"""

CLASSIFIED_SQL = f"""{CALIBRATION_SQL},
classified AS (
  SELECT f.method, item, score_status, failure_code, score, threshold, score_status = 'failed' OR score > threshold AS is_anomalous,
    CASE WHEN score_status = 'failed' OR score > threshold THEN 'anomaly' ELSE 'normal' END AS predicted_class,
    CASE WHEN score_status = 'failed' THEN 'score_failed' WHEN score > threshold THEN 'above_threshold' ELSE 'within_threshold' END AS decision_reason,
    score - threshold AS score_margin
  FROM final_test f JOIN cuts USING (method)),
revealed AS (SELECT classified.*, true_class FROM classified JOIN truth USING (item))"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoregate.operators.scores import classify, thresholds

    cuts = staged(thresholds(calibration(spark, sf_dir)))
    return classify(final_test(spark, sf_dir), cuts)


def revealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoregate.operators.evaluation import reveal

    return reveal(classified(spark, sf_dir), labels(spark, sf_dir))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed observations: events as method (type), item (user), pass (of the order of a user's events of a type) and duration."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("pass_index", F.row_number().over(order) - 1)
    return e.select(
        F.col("event_type").alias("method"),
        F.col("user_id").alias("item"),
        "event_id",
        "pass_index",
        F.when(F.col("event_id") % 211 == 7, "failed").otherwise("ok").alias("score_status"),
        F.col("value").alias("duration")
    )


OBSERVATIONS_SQL = """observations AS (
  SELECT event_type AS method, user_id AS item, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS pass_index,
    CASE WHEN event_id % 211 = 7 THEN 'failed' ELSE 'ok' END AS score_status, value AS duration FROM events)"""

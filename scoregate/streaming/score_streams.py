"""Score streams: thresholds are frozen before the stream starts, so classes are final as rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scoregate.operators.scores import classify

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
LATE = "10 minutes"


def scores_from(spark: SparkSession, path: str) -> DataFrame:
    """A stream of scores from a folder or file of events."""
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet")
    source = stream.option(
        "recursiveFileLookup", "true"
    ).parquet(path) if _is_folder(spark, path) else spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder)
    return source.select(
        F.col("event_type").alias("method"),
        F.col("event_id").alias("item"),
        "ts",
        F.lit("ok").alias("score_status"),
        F.lit(None).cast("string").alias("failure_code"),
        F.col("value").alias("score")
    )


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a Parquet table, and read that."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation", f"{path}/state"
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def classify_stream(scores: DataFrame, cuts: DataFrame) -> DataFrame:
    """Stateless: a stream of scores joined with its methods' frozen thresholds."""
    return classify(scores, cuts)


def classified_events(spark: SparkSession, events: str, cuts: DataFrame, path: str) -> DataFrame:
    return run_to_end(classify_stream(scores_from(spark, events), cuts), path)


def unique_keys(scores: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first row of each key; one repeated within the watermark is dropped."""
    return scores.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def unique_events(spark: SparkSession, events: str, path: str) -> DataFrame:
    return run_to_end(unique_keys(scores_from(spark, events), ["item"]), path)


def windowed(scores: DataFrame, threshold: float, width: str, late: str = LATE) -> DataFrame:
    """Rows and anomalous rows of each method in tumbling windows."""
    above = (F.col("score_status") == "failed") | (F.col("score") > threshold)
    grouped = scores.withWatermark("ts", late).groupBy(F.window("ts", width), "method")
    return grouped.agg(F.count(F.lit(1)).alias("event_count"), F.count_if(above).alias("anomalous_count")).select(
        F.col("window.start").alias("window_start"), "method", "event_count", "anomalous_count"
    )


def window_counts(spark: SparkSession, events: str, threshold: float, width: str, path: str) -> DataFrame:
    """All windows over what is there, the open ones too: each trigger's rows replace the table."""
    tables: list[str] = []

    def put(batch: DataFrame, epoch: int) -> None:
        tables.append(f"{path}/windows-{epoch}")
        batch.write.mode("overwrite").parquet(tables[-1])

    stream = windowed(scores_from(spark, events), threshold, width)
    query = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = "window_start timestamp, method string, event_count long, anomalous_count long"
    return spark.read.schema(schema).parquet(tables[-1]) if tables else spark.createDataFrame([], schema)

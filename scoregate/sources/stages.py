"""Tables written between stages, into the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or the context's checkpoint folder. Only where neither is
    set and everything runs on this machine (a local master, as in tests) it is a temporary folder; on a cluster that is an error,
    as a machine-local folder would lose tables between machines."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_on_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_on_context.isDefined():
        return set_on_context.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="scoregate-"))
    return _own[0]


def stage_path(spark: SparkSession) -> str:
    """A new path in the shared folder. What is written there outlives the query, as its result is read from it; delete folders
    named scoregate-* once the results are stored."""
    return f"{shared_dir(spark)}/scoregate-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The table written and read again: what is read twice is worked out once, and a lost executor loses nothing of it."""
    path = stage_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Sinks: partition replacement, daily event files, exports; and the shared folder they use by default."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import redact

LEVELS = ("debug", "info", "warn", "error")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or under a temporary one where that is unset (single machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df to path and returns a reader of what was written, which cuts lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_partitions(df: DataFrame, path: str, column: str) -> None:
    """Writes df so that the partitions it holds replace those at path and all others stay; a task's retry changes nothing."""
    df.write.partitionBy(column).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def log_lines(logs: DataFrame, least: str = "info") -> DataFrame:
    """(dt, value): redacted JSON lines of records(timestamp, level, event, message) at or above a level."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    own = logs.where(rank >= LEVELS.index(least) + 1)
    line = F.to_json(F.struct("timestamp", "level", "event", redact(F.col("message")).alias("message")))
    return own.select(F.to_date("timestamp").alias("dt"), line.alias("value"))


def write_log(logs: DataFrame, path: str, least: str = "info") -> None:
    """Appends daily partitions of JSON lines."""
    log_lines(logs, least).write.partitionBy("dt").mode("append").text(path)

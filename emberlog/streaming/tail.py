"""Beyond parity: log lines as a stream, with the same parsing Columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.sources import cef, syslog, weblog

PARSERS = {"syslog": syslog.to_events, "web": weblog.to_events, "cef": cef.to_events}


def tail(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Events of the lines of files that arrive in a folder; streams don't number lines."""
    lines = spark.readStream.text(folder, lineSep="\n").select(F.lit(folder).alias("file"), F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("line_no"), F.regexp_replace("value", "\\r\\z", "").alias("line"))
    return PARSERS[kind](lines)


def timed(events: DataFrame, lateness: str) -> DataFrame:
    """Timed events with a watermark on `ts`."""
    return events.where("ts_us is not null").withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", lateness)


def counts(events: DataFrame, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Events and errors per window of time."""
    return timed(events, lateness).groupBy(F.window("ts", width)).agg(F.count("*").alias("count"), F.count_if(F.col("severity") <= 3).alias("error_or_worse"))


def sessions(events: DataFrame, key: str = "src_ip", idle: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions per key as they end."""
    return timed(events, lateness).where(F.col(key) != "").groupBy(F.session_window("ts", idle), F.col(key).alias("key")).agg(F.count("*").alias("events"))

"""The driver's tables as canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as application events of users; pos is the event's number."""
    rows = table(spark, sf_dir, "events")
    number = F.get_json_object("props", "$.k")
    user = F.col("user_id")
    severity = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "signup", 6).otherwise(7)
    values = {
        "ts_us": F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")),
        "severity": severity,
        "source": F.lit("json"),
        "record_index": F.col("event_id") + 1,
        "host": F.concat(F.lit("h"), (user % 8).cast("string")),
        "app": F.col("event_type"),
        "user": F.concat(F.lit("u"), user.cast("string")),
        "src_ip": F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string")),
        "message": F.concat(F.col("event_type"), F.lit(" value "), F.col("value").cast("bigint").cast("string")),
        "fields": F.array(F.struct(F.lit("k").alias("key"), F.lit("int").alias("kind"), number.alias("text"))),
    }
    return schema.event(rows.withColumn("pos", F.col("event_id")), values, ["pos"])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as web requests: the event's type and number give status and path."""
    rows = table(spark, sf_dir, "events")
    user = F.col("user_id")
    status = F.when(F.col("event_type") == "error", 500 + F.col("event_id") % 4).when(F.col("event_type") == "click", 404).otherwise(200)
    values = {
        "ts_us": F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")),
        "severity": schema.from_http(status),
        "source": F.lit("web-access"),
        "src_ip": F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string")),
        "http_method": F.lit("GET"),
        "http_path": F.concat(F.lit("/p/"), (F.col("event_id") % 97).cast("string")),
        "http_status": status,
        "message": F.lit("GET"),
    }
    return schema.event(rows.withColumn("pos", F.col("event_id")), values, ["pos"])


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as logins: errors fail, purchases succeed."""
    rows = table(spark, sf_dir, "events")
    user = F.col("user_id")
    message = F.when(F.col("event_type") == "error", "Failed password for user").when(F.col("event_type") == "purchase", "Accepted password for user").otherwise("tick")
    values = {
        "ts_us": F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")),
        "severity": F.when(F.col("event_type") == "error", 3).otherwise(6),
        "source": F.lit("syslog"),
        "host": F.concat(F.lit("h"), (user % 8).cast("string")),
        "app": F.lit("sshd"),
        "message": message,
    }
    return schema.event(rows.withColumn("pos", F.col("event_id")), values, ["pos"])

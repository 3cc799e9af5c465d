"""Histogram over time from the earliest event on, and gaps between events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.times import floor_div
from emberlog.operators.windows import SECOND, seconds
from emberlog.schema import error_or_worse

MOST_BUCKETS, MOST_GAPS = 100_000, 4096


def buckets(events: DataFrame, width_seconds: int) -> DataFrame:
    """(bucket, start_us, count, error_or_worse), empty ones between included; what lies beyond MOST_BUCKETS joins the last."""
    width = max(1, width_seconds) * SECOND
    timed = events.where("ts_us is not null")
    low = timed.agg(F.min("ts_us").alias("low"))  # one row
    index = F.least(floor_div(F.col("ts_us") - F.col("low"), width), F.lit(MOST_BUCKETS - 1).cast("bigint"))
    counts = timed.join(F.broadcast(low)).groupBy(index.alias("bucket"), "low").agg(F.count("*").alias("count"), F.count_if(error_or_worse()).alias("error_or_worse"))
    ends = counts.agg(F.max("bucket").alias("last"), F.max("low").alias("low")).where("last is not null")
    line = ends.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("bucket"), "low")
    found = line.join(counts.drop("low"), "bucket", "left")
    return found.select("bucket", (F.col("low") + F.col("bucket") * width).alias("start_us"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("error_or_worse", F.lit(0)).alias("error_or_worse"))


def peak(found: DataFrame) -> DataFrame:
    """The first of the fullest buckets: (bucket, start_us, count)."""
    best = F.max(F.struct("count", (-F.col("bucket")).alias("bucket"), "start_us")).alias("b")
    return found.agg(best).where("b is not null").select((-F.col("b.bucket")).alias("bucket"), F.col("b.start_us").alias("start_us"), F.col("b.count").alias("count"))


def gaps(events: DataFrame, threshold_seconds: int, most: int = MOST_GAPS) -> DataFrame:
    """(before_us, after_us, seconds) where consecutive events are further apart than the threshold: the first `most`.

    Time is cut into slices of the threshold. A gap ends in the first event of its slice, so only the
    first and last time of each slice are compared, in order.
    """
    width = threshold_seconds * SECOND
    if threshold_seconds <= 0:
        return events.sparkSession.createDataFrame([], "before_us bigint, after_us bigint, seconds bigint")
    piece = floor_div(F.col("ts_us"), width)
    ends = events.where("ts_us is not null").groupBy(piece.alias("slice")).agg(F.min("ts_us").alias("low"), F.max("ts_us").alias("high"))
    # Slices by block of slices, each with the last slice of the block before: no task sees all of them.
    block = floor_div(F.col("slice"), 4096)
    blocks = ends.groupBy(block.alias("block")).agg(F.max("high").alias("end"))
    before = blocks.withColumn("carried", F.max("end").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1))).select("block", "carried")
    inside = W.partitionBy("block").orderBy("slice")
    lagged = ends.withColumn("block", block).join(before, "block").withColumn("before_us", F.coalesce(F.lag("high").over(inside), "carried"))
    found = lagged.where(F.col("low") - F.col("before_us") > width)
    return found.select("before_us", F.col("low").alias("after_us"), seconds(F.col("low") - F.col("before_us")).alias("seconds")).orderBy("after_us").limit(most)


def untimed(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(F.col("ts_us").isNull()).alias("untimed"))

"""Sessions: events of a key with no pause longer than the idle time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.times import floor_div
from emberlog.operators.tables import written
from emberlog.operators.windows import SECOND, seconds

KEYS = {"ip": "src_ip", "user": "user", "host": "host"}
#: Slices of a key whose pauses are looked at together.
BLOCK = 4096


def _timed(events: DataFrame, by: str, idle_us: int) -> DataFrame:
    """(key, ts_us, pos, slice) of the events that take part; a slice is too short to hold a pause."""
    key = KEYS.get(by, "src_ip")
    rows = events.where(F.col("ts_us").isNotNull() & (F.col(key) != ""))
    return rows.select(F.col(key).alias("key"), "ts_us", "pos", floor_div(F.col("ts_us"), max(1, idle_us)).alias("slice"))


def _slices(rows: DataFrame, idle_us: int) -> DataFrame:
    """(key, slice, low, high, n, first): first is the slice in which the slice's session begins.

    What a block of slices needs of those before it, their last time and the start of their last session,
    comes from one row a block, so no task sees all of a key's slices, let alone its events.
    """
    ends = rows.groupBy("key", "slice").agg(F.min("ts_us").alias("low"), F.max("ts_us").alias("high"), F.count("*").alias("n"))
    ends = written(ends.withColumn("block", floor_div(F.col("slice"), BLOCK)))
    inside = W.partitionBy("key", "block").orderBy("slice")
    earlier = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = lambda df, c: df.groupBy("key", "block").agg(F.max(c).alias("own")).select("key", "block", F.max("own").over(earlier).alias("carried"))
    before = F.coalesce(F.lag("high").over(inside), "carried")
    begins = F.when(before.isNull() | (F.col("low") - before > idle_us), F.col("slice"))
    found = ends.join(carried(ends, "high"), ["key", "block"]).withColumn("begins", begins).drop("carried")
    first = F.coalesce(F.max("begins").over(inside.rowsBetween(W.unboundedPreceding, 0)), "carried")
    return found.join(carried(found, "begins"), ["key", "block"]).select("key", "slice", "low", "high", "n", first.alias("first"))


def sessions(events: DataFrame, by: str = "ip", idle_seconds: int = 1800, positions: bool = True) -> DataFrame:
    """(key, start_us, end_us, duration_seconds, events, positions), ordered by start and key.

    Events without the key or without a time take no part; a pause of exactly the idle time does not split.
    Time is cut into slices of the idle time, which are summed before anything meets. Without positions no
    event is shuffled; with them a session's positions are one array.
    """
    idle = max(0, idle_seconds) * SECOND
    rows = _timed(events, by, idle)
    slices = _slices(rows, idle)
    found = slices.groupBy("key", "first").agg(F.min("low").alias("start_us"), F.max("high").alias("end_us"), F.sum("n").alias("events"))
    columns = ["key", "start_us", "end_us", seconds(F.col("end_us") - F.col("start_us")).alias("duration_seconds"), "events"]
    if positions:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("ts_us", "pos"))), lambda x: x["pos"]).alias("positions")
        members = rows.join(slices.select("key", "slice", "first"), ["key", "slice"]).groupBy("key", "first").agg(listed)
        found, columns = found.join(members, ["key", "first"]), [*columns, "positions"]
    return found.select(*columns).orderBy("start_us", "key")

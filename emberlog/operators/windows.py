"""Sliding windows per key that spread over tasks by time, so that one busy key is no burden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.times import floor_div

SECOND = 1_000_000
#: Windows that fit into a slice of time; a slice also holds the window before it, so this bounds the copies.
SLICES = 16
#: Parts of a window whose events are summed together.
BLOCKS = 16


def sliced(rows: DataFrame, window_us: int, ts: str = "ts_us") -> DataFrame:
    """Adds `slice` and `own`: each row belongs to its slice, and as a guest to the next if a window may reach back to it."""
    width = F.lit(max(1, window_us) * SLICES).cast("bigint")
    at = floor_div(F.col(ts), width)
    late = F.col(ts) >= (at + 1) * width - window_us
    copies = F.when(late, F.array(at, at + 1)).otherwise(F.array(at))
    return rows.withColumn("_at", at).withColumn("slice", F.explode(copies)).withColumn("own", F.col("slice") == F.col("_at")).drop("_at")


def densest(rows: DataFrame, key: str, window_us: int) -> DataFrame:
    """Of each key the fullest window: count, first_us, last_us; of equal ones the earliest.

    Events of a moment are counted first; a moment adds its count when it comes and takes it back when the
    window has left it. These steps are summed within blocks, and what a block needs of those beside it (the
    sum before it, the next moment to leave after it) comes from one row a block: the work grows with the
    events, not with events times those in a window, and no task holds more than blocks of a key.
    """
    seen = sliced(rows.groupBy(key, "ts_us").agg(F.count("*").alias("n")), window_us)
    come = F.struct(F.col("ts_us").alias("t"), F.col("n").alias("d"), F.col("own").alias("ends"))
    leave = F.struct((F.col("ts_us") + F.lit(window_us + 1).cast("bigint")).alias("t"), (-F.col("n")).alias("d"), F.lit(False).alias("ends"))
    steps = seen.select(key, "slice", F.explode(F.array(come, leave)).alias("step")).select(key, "slice", "step.*")
    steps = steps.withColumn("block", floor_div(F.col("t"), _block(window_us)))
    inside = W.partitionBy(key, "slice", "block")
    # At one moment those that leave go first, so each end of a window has them behind it in either direction.
    before, after = inside.orderBy("t", "d").rowsBetween(W.unboundedPreceding, 0), inside.orderBy(F.desc("t"), F.desc("d")).rowsBetween(W.unboundedPreceding, 0)
    summed = steps.withColumn("n", F.sum("d").over(before)).withColumn("leaves", F.min(F.when(F.col("d") < 0, F.col("t"))).over(after))
    best = F.max(F.when(F.col("ends"), F.struct("n", (-F.col("t")).alias("last"), "leaves"))).alias("b")
    blocks = summed.groupBy(key, "slice", "block").agg(F.sum("d").alias("d"), F.min(F.when(F.col("d") < 0, F.col("t"))).alias("leaves"), best)
    along = W.partitionBy(key, "slice").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    back = W.partitionBy(key, "slice").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("sum", F.coalesce(F.sum("d").over(along), F.lit(0))).withColumn("later", F.min("leaves").over(back)).where("b is not null")
    # The first moment of a window is the next to leave.
    ends = blocks.select(key, F.struct((F.col("sum") + F.col("b.n")).alias("n"), F.col("b.last").alias("last"), F.coalesce("b.leaves", "later").alias("leaves")).alias("b"))
    found = ends.groupBy(key).agg(F.max("b").alias("b"))
    return found.select(key, F.col("b.n").alias("count"), (F.col("b.leaves") - F.lit(window_us + 1).cast("bigint")).alias("first_us"), (-F.col("b.last")).alias("last_us"))


def _block(window_us: int) -> int:
    return max(1, window_us // BLOCKS)


def within(rows: DataFrame, found: DataFrame, key: str, window_us: int) -> DataFrame:
    """The rows (key, ts_us and more) inside the windows (key, first_us, last_us) of found; they meet by blocks of time, so a busy key spreads over tasks."""
    block = lambda c: floor_div(F.col(c), _block(window_us))
    spans = found.select(F.col(key).alias("_k"), "first_us", "last_us", F.explode(F.sequence(block("first_us"), block("last_us"))).alias("_b"))
    met = (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_b")) & F.col("ts_us").between(F.col("first_us"), F.col("last_us"))
    return rows.withColumn("_at", block("ts_us")).join(spans, met).select(*rows.columns)


def densest_distinct(rows: DataFrame, key: str, target: str, window_us: int) -> DataFrame:
    """Of each key the window with most distinct targets: count, first_us, last_us, last_pos.

    A target counts from an event until the window has left it or its next event takes over: +1 and
    -1 on a time line, summed. The window ends at the last new target of its last moment. Neighbours are
    sought within a slice: an event's guests reach as far back as a window, and farther ones change nothing.
    """
    again = W.partitionBy(key, target, "slice").orderBy("ts_us", "pos")
    seen = sliced(rows.select(key, target, "ts_us", "pos"), window_us)
    seen = seen.withColumn("before", F.lag("ts_us").over(again)).withColumn("next", F.lead("ts_us").over(again))
    seen = seen.withColumn("fresh", F.col("before").isNull() | (F.col("before") < F.col("ts_us") - window_us))
    leave = F.least(F.col("ts_us") + window_us + 1, F.col("next"))
    steps = seen.withColumn("step", F.explode(F.array(F.struct(F.col("ts_us").alias("t"), F.lit(1).alias("d")), F.struct(leave.alias("t"), F.lit(-1).alias("d")))))
    moments = steps.groupBy(key, "slice", "step.t").agg(F.sum("step.d").alias("d"), F.max(F.when((F.col("step.d") == 1) & F.col("own"), F.lit(True))).alias("at_event"))
    running = moments.withColumn("n", F.sum("d").over(W.partitionBy(key, "slice").orderBy("t").rowsBetween(W.unboundedPreceding, 0))).where("at_event")
    best = running.groupBy(key).agg(F.max(F.struct("n", (-F.col("t")).alias("t"))).alias("b")).select(key, F.col("b.n").alias("count"), (-F.col("b.t")).alias("last_us"))
    ends = seen.where("own and fresh").select(F.col(key).alias("_k"), "ts_us", "pos")
    last = best.join(ends, (F.col(key) == F.col("_k")) & (F.col("ts_us") == F.col("last_us"))).groupBy(key, "count", "last_us").agg(F.max("pos").alias("last_pos"))
    reach = rows.select(F.col(key).alias("_k"), "ts_us")
    inside = (F.col(key) == F.col("_k")) & (F.col("ts_us") >= F.col("last_us") - window_us) & (F.col("ts_us") <= F.col("last_us"))
    return last.join(reach, inside).groupBy(key, "count", "last_us", "last_pos").agg(F.min("ts_us").alias("first_us"))


def first_events(rows: DataFrame, cap: int, *keys: str) -> DataFrame:
    """(keys, first): (ts_us, pos) of the first `cap` events of each key by time; cut in slices before they meet."""
    part = W.partitionBy(*keys, F.pmod(F.col("pos"), F.lit(64))).orderBy("ts_us", "pos")
    few = rows.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= cap)
    nearest = few.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("ts_us", "pos"))).where(F.col("_n") <= cap)
    return nearest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts_us", "pos"))).alias("first"))


def first_positions(rows: DataFrame, cap: int, *keys: str) -> DataFrame:
    """(keys, evidence): positions of the first `cap` events of each key by time."""
    return first_events(rows, cap, *keys).select(*keys, F.transform("first", lambda x: x["pos"]).alias("evidence"))


def seconds(us: Column) -> Column:
    """Whole seconds, towards zero."""
    return F.call_function("div", us.cast("bigint"), F.lit(SECOND).cast("bigint"))

"""Tables in the shared folder, and positions in a global order without a single task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table below spark.checkpoint.dir, so lost executors recompute nothing."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="emberlog-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/emberlog-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """Adds the place of each row in the global order: a range sort, then the rows of the parts before each part."""
    plain = df.drop(name) if name in df.columns and not any(name == str(o) for o in order) else df
    parts = written(plain.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = sorted(parts.groupBy("_part").count().collect())  # one row per task
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "_part int, _before bigint")
    placed = parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at"))
    return placed.select(*[c for c in df.columns if c != name], name)


def sort_by_time(events: DataFrame) -> DataFrame:
    """Events by time, untimed first, ties in their old order; `pos` is the new place."""
    old = events.withColumnRenamed("pos", "_old")
    return numbered(old, [F.col("ts_us").asc_nulls_first(), F.col("_old").asc()]).drop("_old")

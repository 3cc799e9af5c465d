"""Counts over events: one pass for the scalars, one for all dimensions together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.events import signature
from emberlog.operators.windows import seconds
from emberlog.schema import error_or_worse, severity_name

#: Dimensions in the order of the report, with their titles.
DIMENSIONS = {
    "source": "By source format", "severity": "By severity", "host": "By host", "app": "By app", "src_ip": "Top source IPs",
    "user": "Top users", "http_class": "HTTP status classes", "signature": "Top signatures",
}


def http_class(status: Column) -> Column:
    """1xx to 5xx; null outside."""
    return F.when(status.between(100, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx")))


def _keys() -> dict[str, Column]:
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return {
        "source": F.col("source"), "severity": severity_name(F.col("severity")), "host": some("host"), "app": some("app"),
        "src_ip": some("src_ip"), "user": some("user"), "http_class": http_class(F.col("http_status")), "signature": signature(),
    }


def scalars(events: DataFrame) -> DataFrame:
    """total, timed, untimed, error_or_worse, earliest, latest, span_seconds: one row."""
    sums = events.agg(
        F.count("*").alias("total"), F.count("ts_us").alias("timed"), F.count_if(error_or_worse()).alias("error_or_worse"), F.min("ts_us").alias("earliest"), F.max("ts_us").alias("latest")
    )
    span = F.when(F.col("timed") >= 2, seconds(F.col("latest") - F.col("earliest"))).otherwise(0).cast("bigint")
    return sums.select("total", "timed", (F.col("total") - F.col("timed")).alias("untimed"), "error_or_worse", "earliest", "latest", span.alias("span_seconds"))


def counters(events: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """(dimension, key, count) for all dimensions; empty keys don't count. Sums are made before the shuffle."""
    keys = {d: k for d, k in _keys().items() if dimensions is None or d in dimensions}
    if len(keys) == 1:
        (d, k), = keys.items()
        return events.select(k.alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("count")).select(F.lit(d).alias("dimension"), "key", "count")
    pairs = F.filter(F.array(*(F.struct(F.lit(d).alias("dimension"), k.alias("key")) for d, k in keys.items())), lambda p: p["key"].isNotNull())
    return events.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.key").agg(F.count("*").alias("count"))


def top(counts: DataFrame, n: int = 0) -> DataFrame:
    """Keys by count, then by their bytes; n = 0 gives all."""
    ordered = counts.orderBy(F.desc("count"), F.asc("key"))
    return ordered.limit(n) if n else ordered


def at_least(events: DataFrame, level: int) -> DataFrame:
    """How many events are as severe as a level."""
    from emberlog.schema import at_least_as_severe

    return events.agg(F.count_if(at_least_as_severe(F.col("severity").cast("int"), F.lit(level))).alias("count"))


def totals(counts: DataFrame) -> DataFrame:
    """(dimension, distinct, total)."""
    return counts.groupBy("dimension").agg(F.count("*").alias("distinct"), F.sum("count").alias("total"))


def first_keys(events: DataFrame, dimension: str, most: int) -> DataFrame:
    """Counts of the keys that arrive first, for those who want the number of keys bounded; by default nothing is."""
    key = _keys()[dimension]
    seen = events.select(key.alias("key"), "pos").where("key is not null").groupBy("key").agg(F.count("*").alias("count"), F.min("pos").alias("since"))
    return seen.orderBy("since").limit(most).select("key", "count")

"""Detectors over events: bursts, scans, spikes and rare signatures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import truncate
from emberlog.operators import events as E
from emberlog.operators.windows import SECOND, densest, densest_distinct, first_events, first_positions, within

#: Names of findings (log-gap is a name that no detector gives) and their severities.
KINDS = {
    "auth-brute-force": 1, "auth-spray-then-hit": 2, "http-error-burst": 4, "port-or-path-scan": 4, "severity-spike": 3, "rare-signature": 5, "log-gap": 8,
}
DETAILS = {
    "auth-brute-force": "repeated authentication failures concentrated in a short window, consistent with a brute-force attempt",
    "auth-spray-then-hit": "a login succeeded from an actor that had already produced a brute-force burst of failures, suggesting a compromised credential",
    "http-error-burst": "a burst of client/server error responses to one client, which can indicate scanning, fuzzing, or a failing integration",
    "port-or-path-scan": "one source reached many distinct paths/ports in a short window, consistent with enumeration or scanning",
    "severity-spike": "a concentrated burst of high-severity events, which may signal an incident, outage, or active attack",
    "rare-signature": "an event type that occurs only a handful of times across the whole stream, which is worth a human glance",
}
GLOBAL = "(global)"
#: Parts of an actor's successes.
PARTS = 16


@dataclass(frozen=True)
class DetectionConfig:
    """Thresholds; a minimum of 0 switches a window detector off."""

    bruteforce_min_failures: int = 5
    bruteforce_window_seconds: int = 120
    http_error_min: int = 20
    http_error_window_seconds: int = 60
    scan_distinct_min: int = 25
    scan_window_seconds: int = 60
    severity_spike_min: int = 10
    severity_spike_window_seconds: int = 30
    rare_signature_max: int = 3
    evidence_cap: int = 32


def _finding(rows: DataFrame, kind: str, title: Column) -> DataFrame:
    """kind, severity, entity, count, first_us, last_us, title, detail, evidence."""
    return rows.select(
        F.lit(kind).alias("kind"), F.lit(KINDS[kind]).cast("tinyint").alias("severity"), "entity", F.col("count").cast("bigint").alias("count"), "first_us", "last_us", title.alias("title"), F.lit(DETAILS[kind]).alias("detail"), "evidence"
    )


def _count() -> Column:
    return F.col("count").cast("string")


def _who() -> Column:
    return truncate(F.col("entity"), 64)


def _burst(rows: DataFrame, least: int, window_seconds: int, cap: int) -> DataFrame:
    """entity, count, first_us, last_us, evidence of the densest window of each entity that has enough."""
    best = densest(rows, "entity", window_seconds * SECOND).where((F.col("count") >= least) & F.lit(least > 0))
    inside = within(rows, best, "entity", window_seconds * SECOND)
    return best.join(first_positions(inside, cap, "entity"), "entity")


def _timed(events: DataFrame, condition: Column) -> DataFrame:
    return events.where(condition & F.col("ts_us").isNotNull()).select(E.actor().alias("entity"), "ts_us", "pos").where("entity <> ''")


def auth_bruteforce(events: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    failed = _timed(events, E.is_failed_auth())
    found = _burst(failed, cfg.bruteforce_min_failures, cfg.bruteforce_window_seconds, cfg.evidence_cap)
    title = F.concat(_count(), F.lit(" failed authentications from "), _who(), F.lit(f" within {cfg.bruteforce_window_seconds}s"))
    return _finding(found, "auth-brute-force", title)


def spray_then_hit(events: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """For brute-forced actors: the first success at or after the N-th failure of all."""
    n = cfg.bruteforce_min_failures
    failed = _timed(events, E.is_failed_auth())
    burst = densest(failed, "entity", cfg.bruteforce_window_seconds * SECOND).where((F.col("count") >= n) & F.lit(n > 0)).select("entity", "count")
    # The N-th failure by its position among the first ones, and the time of the very first.
    first = first_events(failed, max(n, cfg.evidence_cap), "entity").withColumnRenamed("first", "fails")
    at = lambda k: F.get("fails", F.lit(k))["ts_us"]
    marks = burst.join(first, "entity").select("entity", "count", "fails", at(0).alias("first_us"), at(max(0, n - 1)).alias("from_us"))
    # Only an actor's first success is sought, in parts, so that a busy actor's successes don't meet in one task.
    passed = _timed(events, E.is_successful_auth() & ~E.is_failed_auth()).withColumn("part", F.pmod("pos", F.lit(PARTS)).cast("int"))
    since = marks.select("entity", "from_us", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
    hit = passed.join(since, ["entity", "part"]).where("ts_us >= from_us").groupBy("entity").agg(F.min(F.struct("ts_us", "pos")).alias("hit"))
    shown = F.transform(F.slice("fails", 1, max(0, cfg.evidence_cap - 1)), lambda x: x["pos"])
    found = marks.join(hit, "entity").select("entity", "count", "first_us", F.col("hit.ts_us").alias("last_us"), F.concat(shown, F.array("hit.pos")).alias("evidence"))
    title = F.concat(F.lit("successful authentication from "), _who(), F.lit(" after "), _count(), F.lit(" failures"))
    return _finding(found, "auth-spray-then-hit", title)


def http_error_bursts(events: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    rows = _timed(events, F.col("http_status").between(400, 599))
    found = _burst(rows, cfg.http_error_min, cfg.http_error_window_seconds, cfg.evidence_cap)
    title = F.concat(_count(), F.lit(" HTTP 4xx/5xx responses to "), _who(), F.lit(f" within {cfg.http_error_window_seconds}s"))
    return _finding(found, "http-error-burst", title)


def target() -> Column:
    """What an event touches: a path, else a port; null for neither."""
    path, port = F.concat(F.lit("path:"), "http_path"), F.concat(F.lit("port:"), F.col("dst_port").cast("string"))
    return F.when(F.col("http_path") != "", path).when(F.col("dst_port") != 0, port)


def scans(events: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    rows = events.where("ts_us is not null").select(E.actor().alias("entity"), target().alias("target"), "ts_us", "pos").where("target is not null and entity <> ''")
    best = densest_distinct(rows, "entity", "target", cfg.scan_window_seconds * SECOND).where((F.col("count") >= cfg.scan_distinct_min) & F.lit(cfg.scan_distinct_min > 0))
    last = F.struct("ts_us", "pos") <= F.struct(F.col("last_us"), F.col("last_pos"))
    inside = rows.join(best.select(F.col("entity").alias("_e"), "first_us", "last_us", "last_pos"), (F.col("entity") == F.col("_e")) & (F.col("ts_us") >= F.col("first_us")) & last)
    found = best.join(first_positions(inside.select("entity", "ts_us", "pos"), cfg.evidence_cap, "entity"), "entity")
    title = F.concat(_who(), F.lit(" touched "), _count(), F.lit(f" distinct targets within {cfg.scan_window_seconds}s"))
    return _finding(found, "port-or-path-scan", title)


def severity_spikes(events: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Over all events together; slices of time keep it off a single task."""
    rows = events.where("ts_us is not null and severity <= 3").select(F.lit(GLOBAL).alias("entity"), "ts_us", "pos")
    found = _burst(rows, cfg.severity_spike_min, cfg.severity_spike_window_seconds, cfg.evidence_cap)
    title = F.concat(_count(), F.lit(f" error-or-worse events within {cfg.severity_spike_window_seconds}s"))
    return _finding(found, "severity-spike", title)


def rare_signatures(events: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Untimed events count too. Only signatures that are rare are gathered."""
    named = events.select(E.signature().alias("entity"), "ts_us", "pos")
    rare = named.groupBy("entity").agg(F.count("*").alias("count"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")).where(F.col("count") <= cfg.rare_signature_max)
    few = named.join(rare.select("entity"), "entity", "left_semi").groupBy("entity").agg(F.slice(F.array_sort(F.collect_list("pos")), 1, max(1, cfg.evidence_cap)).alias("evidence"))
    found = rare.join(few, "entity")
    if cfg.evidence_cap == 0:
        found = found.withColumn("evidence", F.array().cast("array<bigint>"))
    title = F.concat(F.lit("rare event signature seen "), _count(), F.lit(" time(s): "), truncate(F.col("entity"), 80))
    return _finding(found, "rare-signature", title)


def run(events: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """All findings over events with positions in time order (see tables.sort_by_time), ordered by first time, kind and entity."""
    found = auth_bruteforce(events, cfg)
    for detector in (spray_then_hit, http_error_bursts, scans, severity_spikes, rare_signatures):
        found = found.unionByName(detector(events, cfg))
    return found.orderBy(F.col("first_us").asc_nulls_first(), "kind", "entity")


def evidence(findings: DataFrame, events: DataFrame) -> DataFrame:
    """The events behind findings: kind, entity, nth and the event's columns, joined by position."""
    rows = findings.select("kind", "entity", F.posexplode("evidence").alias("nth", "pos"))
    return rows.join(events, "pos")

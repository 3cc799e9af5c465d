"""Text renderings of small results; only bounded numbers of rows come to the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from emberlog.functions.text import sanitize, truncate
from emberlog.functions.times import to_iso8601
from emberlog.operators import detect, stats, timeline
from emberlog.operators.detect import DetectionConfig
from emberlog.operators.tables import sort_by_time
from emberlog.schema import severity_name

TOP, ROWS, EVIDENCE = 10, 200, 16


@dataclass(frozen=True)
class ReportOptions:
    include_statistics: bool = True
    include_timeline: bool = True
    include_findings: bool = True
    bucket_width_seconds: int = 3600
    gap_threshold_seconds: int = 3600
    top_n: int = 10


def _shown(c: str, most: int):
    return truncate(sanitize(F.col(c)), most)


def statistics(events: DataFrame) -> str:
    one = stats.scalars(events).select("*", to_iso8601(F.col("earliest")).alias("a"), to_iso8601(F.col("latest")).alias("b")).first()
    lines = [
        f"Total events:       {one.total}", f"Timed events:       {one.timed}", f"Untimed events:     {one.untimed}", f"Error or worse:     {one.error_or_worse}",
        f"Earliest:           {one.a}", f"Latest:             {one.b}", f"Span (seconds):     {one.span_seconds}",
    ]
    counts = stats.counters(events).persist()
    sums = {r.dimension: r for r in stats.totals(counts).collect()}
    for dimension, title in stats.DIMENSIONS.items():
        own = sums.get(dimension)
        lines += ["", f"{title} ({own.distinct if own else 0} distinct, {own.total if own else 0} total):"]
        rows = stats.top(counts.where(F.col("dimension") == dimension), TOP).select(_shown("key", 100).alias("key"), "count").collect() if own else []
        lines += [f"    {r.key}  {r['count']}" for r in rows] or ["    (none)"]
    counts.unpersist()
    return "\n".join(lines) + "\n"


def time_line(events: DataFrame, width_seconds: int, gap_seconds: int) -> str:
    found = timeline.buckets(events, width_seconds)
    n = found.count()
    gaps = timeline.gaps(events, gap_seconds)
    rows = found.orderBy("bucket").limit(ROWS).select(to_iso8601(F.col("start_us")).alias("start"), "count", "error_or_worse").collect()
    apart = gaps.select(to_iso8601(F.col("before_us")).alias("a"), to_iso8601(F.col("after_us")).alias("b"), "seconds").collect()  # MOST_GAPS at most
    lines = [f"Bucket width (seconds): {max(1, width_seconds)}", f"Buckets:                {n}", f"Untimed events:         {timeline.untimed(events).first().untimed}", f"Gaps recorded:          {len(apart)}"]
    if n:
        best = timeline.peak(found).select(to_iso8601(F.col("start_us")).alias("start"), "count").first()
        lines.append(f"Peak bucket:            {best.start}  ({best['count']} events)")
    lines.append("")
    if n:
        lines += ["Histogram:", *(f"    {r.start}  count={r['count']}  err={r.error_or_worse}" for r in rows)]
        lines += [f"    ... ({n - ROWS} more buckets)"] if n > ROWS else []
    else:
        lines.append("(no timed events)")
    if apart:
        lines += ["", "Gaps (> threshold):", *(f"    {g.a}  ->  {g.b}   ({g.seconds}s)" for g in apart[:ROWS])]
        lines += [f"    ... ({len(apart) - ROWS} more gaps)"] if len(apart) > ROWS else []
    return "\n".join(lines) + "\n"


def session_list(found: DataFrame, limit: int = 50) -> str:
    n = found.count()
    if not n:
        return "Sessions: 0\n(none)\n"
    rows = (found.limit(limit) if limit else found).select(_shown("key", 80).alias("key"), to_iso8601(F.col("start_us")).alias("a"), to_iso8601(F.col("end_us")).alias("b"), "duration_seconds", "events")
    out = [f"Sessions: {n}", ""]
    for r in rows.toLocalIterator():
        out += [f"  key={r.key}", f"    start:    {r.a}", f"    end:      {r.b}", f"    duration: {r.duration_seconds}s", f"    events:   {r.events}"]
    out += [f"... ({n - limit} more sessions)"] if limit and n > limit else []
    return "\n".join(out) + "\n"


def _finding(r: Row) -> str:
    out = f"[{r.severity}] {r.kind}: {r.title}\n    entity:   {r.entity}\n    count:    {r['count']}\n    window:   {r.a}  ->  {r.b}\n"
    out += f"    detail:   {r.detail}\n" if r.detail else ""
    if r.evidence:
        more = f"... (+{len(r.evidence) - EVIDENCE} more)" if len(r.evidence) > EVIDENCE else ""
        listed = ", ".join(f"#{k}" for k in r.evidence[:EVIDENCE])
        out += f"    evidence: {listed}{more}\n"
    return out


def findings(found: DataFrame, limit: int = 0) -> list[str]:
    rows = found.select(severity_name(F.col("severity")).alias("severity"), "kind", _shown("title", 120).alias("title"), _shown("entity", 100).alias("entity"), "count", to_iso8601(F.col("first_us")).alias("a"), to_iso8601(F.col("last_us")).alias("b"), _shown("detail", 200).alias("detail"), "evidence")
    return [_finding(r) for r in (rows.limit(limit) if limit else rows).toLocalIterator()]


def full(events: DataFrame, options: ReportOptions = ReportOptions(), cfg: DetectionConfig = DetectionConfig(), title: str = "Event report") -> str:
    rule = "=" * 56

    def header(text: str) -> str:
        return f"{rule}\n{text}\n{rule}\n"

    one = stats.scalars(events).first()
    out = header(title) + f"Events in stream: {one.total}\nTimed events:     {one.timed}\n\n"
    if options.include_statistics:
        out += header("Statistics") + statistics(events) + "\n"
    if options.include_timeline:
        out += header("Timeline") + time_line(events, options.bucket_width_seconds, options.gap_threshold_seconds) + "\n"
    if options.include_findings:
        found = detect.run(sort_by_time(events), cfg).persist()
        n, cap = found.count(), options.top_n * 10
        shown = findings(found, cap)
        out += header("Findings") + f"Total findings: {n}\n\n" + ("".join(f"{x}\n" for x in shown) or "(no findings)\n")
        out += f"... ({n - cap} more findings)\n" if cap and n > cap else ""
        out += "\n"
        found.unpersist()
    return out

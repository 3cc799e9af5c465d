"""python -m emberlog.cli parse | stats | timeline | detect | export ARTIFACT..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import detect, query, report, sessions, sinks
from emberlog.operators.detect import DetectionConfig
from emberlog.operators.events import summary
from emberlog.operators.tables import sort_by_time
from emberlog.sources.ingest import IngestOptions, ingest

DIAGNOSTICS = 4096


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="emberlog")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("paths", nargs="+")
    common.add_argument("-f", "--format", default="auto")
    common.add_argument("--year", type=int, default=1970)
    common.add_argument("--diagnostics", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("parse", parents=[common])
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--fields", action="store_true")
    sub.add_parser("stats", parents=[common])
    p = sub.add_parser("timeline", parents=[common])
    for name, value in (("--bucket", 3600), ("--gap", 3600), ("--idle", 1800), ("--limit", 50)):
        p.add_argument(name, type=int, default=value)
    p.add_argument("--sessions", choices=("ip", "user", "host"))
    p = sub.add_parser("detect", parents=[common])
    for name, value in (("--bf-failures", 5), ("--bf-window", 120), ("--http-errors", 20), ("--scan-distinct", 25)):
        p.add_argument(name, type=int, default=value)
    p.add_argument("--evidence", action="store_true")
    p = sub.add_parser("export", parents=[common])
    p.add_argument("-o", "--out", choices=("ndjson", "json", "csv"), default="ndjson")
    p.add_argument("--filter", default="")
    return top


def _lines(rows: DataFrame, column: str):
    for r in rows.select(column).toLocalIterator():
        print(r[0])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("emberlog").getOrCreate()
    try:
        chosen = query.parse(getattr(args, "filter", ""))
        events, said = ingest(spark, args.paths, IngestOptions(args.format, args.year))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    except OSError as e:
        print(e, file=sys.stderr)
        return 1
    if args.command == "parse":
        rows = events.orderBy("pos")
        rows = rows.limit(args.limit) if args.limit > 0 else rows
        own = F.array_join(F.transform("fields", lambda f: F.concat(F.lit("    "), f["key"], F.lit(" = "), f["text"])), "\n")
        _lines(rows.select(F.concat_ws("\n", summary(), F.nullif(own, F.lit(""))).alias("line") if args.fields else summary().alias("line")), "line")
    elif args.command == "stats":
        print(report.statistics(events), end="")
    elif args.command == "timeline":
        positive = lambda v, d: v if v > 0 else d
        print(report.time_line(events, positive(args.bucket, 3600), args.gap), end="")
        if args.sessions:
            found = sessions.sessions(events, args.sessions, positive(args.idle, 1800), positions=False)
            print("\n" + report.session_list(found, positive(args.limit, 50)), end="")
    elif args.command == "detect":
        cfg = DetectionConfig(bruteforce_min_failures=args.bf_failures, bruteforce_window_seconds=args.bf_window, http_error_min=args.http_errors, scan_distinct_min=args.scan_distinct)
        ordered = sort_by_time(events)
        found = detect.run(ordered, cfg).persist()
        print(f"Findings: {found.count()}\n")
        for text in report.findings(found):
            print(text)
        if args.evidence:
            _lines(detect.evidence(found, ordered).orderBy("kind", "entity", "nth").select(F.concat(F.lit("#"), F.col("pos").cast("string"), F.lit("  "), summary()).alias("line")), "line")
    else:
        rows = events.where(chosen.column()).orderBy("pos")
        if args.out == "csv":
            print(sinks.csv_header())
        _lines(sinks.csv(rows) if args.out == "csv" else sinks.ndjson(rows), "value")
    if args.diagnostics:
        for d in said.limit(DIAGNOSTICS).collect():
            print(f"[{d.level}] {d.where}: {d.detail}" + (f" (line {d.line})" if d.line else ""), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Artifacts of any format as one frame of events, and one of diagnostics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.operators.tables import numbered
from emberlog.sources import cef, evtx, jsonl, syslog, weblog
from emberlog.sources.detect import detect, files, parse_name
from emberlog.sources.lines import read_lines


@dataclass(frozen=True)
class IngestOptions:
    format: str = "auto"
    assume_year: int = 1970


def events_of(spark: SparkSession, kind: str, paths: list[str], year: int = 1970) -> DataFrame:
    """Canonical events with file, line_no and diag of artifacts of one format."""
    if kind == "evtx":
        return evtx.to_events(evtx.read_files(spark, paths))
    lines = read_lines(spark, paths)
    return {"syslog": lambda: syslog.to_events(lines, year), "web": lambda: weblog.to_events(lines), "json": lambda: jsonl.to_events(lines, year), "cef": lambda: cef.to_events(lines, year)}[kind]()


def ingest(spark: SparkSession, paths: str | list[str], options: IngestOptions = IngestOptions()) -> tuple[DataFrame, DataFrame]:
    """(events, diagnostics). Events carry `file` and `pos`, their place in the order of files and records.

    Diagnostics: level, where, detail, line, file; with format auto, an info for each file says what was found.
    """
    kind = parse_name(options.format)
    if kind is None:
        raise ValueError(f"unknown format: {options.format}")
    found = files(spark, paths)
    kinds = detect(spark, found) if kind == "auto" else dict.fromkeys(found, kind)
    frames = [events_of(spark, k, sorted(p for p, x in kinds.items() if x == k), options.assume_year) for k in sorted(set(kinds.values()))]
    if not frames:
        none = spark.createDataFrame([], "file string, line_no bigint, diag struct<level:string,where:string,detail:string,line:bigint>")
        frames = [schema.event(none, {}, ["file", "line_no", "diag"])]
    rows = numbered(reduce(DataFrame.unionByName, frames), [F.col("file"), F.col("line_no")])
    said = rows.where("diag is not null").select("diag.*", "file")
    if kind == "auto" and kinds:
        notes = [("info", "ingest", f"auto-detected format: {k}", 0, p) for p, k in sorted(kinds.items())]
        said = spark.createDataFrame(notes, said.schema).unionByName(said)
    return rows.drop("diag", "line_no"), said

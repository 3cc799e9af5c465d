"""What the line parsers share: events with diagnostics, and ordered field lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.functions.text import let

DIAGNOSTIC = "struct<level:string,where:string,detail:string,line:bigint>"


def diagnostic(level: str, where: str, detail: Column | str, line: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(where).alias("where"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"), line.cast("bigint").alias("line")).cast(DIAGNOSTIC)


def no_diagnostic() -> Column:
    return F.lit(None).cast(DIAGNOSTIC)


def events(rows: DataFrame, values: dict[str, Column], problem: Column) -> DataFrame:
    """Canonical events with file, line_no and the row's diagnostic (null if there is none)."""
    made = rows.withColumn("diag", problem)
    return schema.event(made, values, ["file", "line_no", "diag"])


def string_fields(pairs: Column) -> Column:
    """array<struct<key, text>> as an ordered map: a key keeps its first place and has its last value."""
    last = lambda p, k: F.element_at(F.filter(p, lambda x: x["key"] == k), -1)["text"]
    return let(pairs, lambda p: F.transform(F.array_distinct(F.transform(p, lambda x: x["key"])), lambda k: F.struct(k.alias("key"), F.lit("string").alias("kind"), last(p, k).alias("text"))))

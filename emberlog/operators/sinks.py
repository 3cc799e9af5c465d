"""Events as JSON lines and CSV text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.times import to_iso8601
from emberlog.schema import severity_name

#: Columns in the order of the text formats.
ORDER = (
    "timestamp", "severity", "source", "record_index", "host", "app", "pid", "user", "src_ip", "dst_ip", "src_port", "dst_port",
    "http_method", "http_path", "http_status", "bytes", "event_id", "channel", "provider", "message",
)
TEXTS = ("host", "app", "user", "src_ip", "dst_ip", "http_method", "http_path", "channel", "provider", "message")


#: Short escapes; other control bytes are written as \\u00xx.
ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_escape(c: Column) -> Column:
    """Quotes, backslashes and control bytes; others stay as they are."""
    table = {chr(k): f"\\u{k:04x}" for k in range(0x20)} | ESCAPES
    names = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    parts = F.regexp_extract_all(c, F.lit('(?s)[^"\\\\\\x00-\\x1F]+|.'), F.lit(0))
    return F.when(c.rlike('["\\\\\\x00-\\x1F]'), F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(names, p), p)), "")).otherwise(c)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), json_escape(c), F.lit('"'))


def json_text() -> Column:
    """One object; what is absent is left out, but severity, source and record_index are always there."""
    member = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    parts = []
    for name in ORDER:
        if name == "timestamp":
            part = F.when(F.col("ts_us").isNotNull(), member(name, _quoted(to_iso8601(F.col("ts_us")))))
        elif name == "severity":
            part = member(name, _quoted(severity_name(F.col(name))))
        elif name == "source":
            part = member(name, _quoted(F.col(name)))
        elif name == "record_index":
            part = member(name, F.col(name).cast("string"))
        elif name == "pid":
            part = F.when(F.col(name) >= 0, member(name, F.col(name).cast("string")))
        elif name in TEXTS:
            part = F.when(F.col(name) != "", member(name, _quoted(F.col(name))))
        else:
            part = F.when(F.col(name) != 0, member(name, F.col(name).cast("string")))
        parts.append(part)
    own = F.transform("fields", lambda f: F.concat(_quoted(f["key"]), F.lit(":"), _quoted(f["text"])))
    parts.append(F.when(F.size("fields") > 0, F.concat(F.lit('"fields":{'), F.array_join(own, ","), F.lit("}"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def csv_quote(c: Column) -> Column:
    return F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_header() -> str:
    return ",".join(ORDER)


def csv_text() -> Column:
    """One record; zeros are blank except record_index, and so is a negative pid."""
    cells = []
    for name in ORDER:
        if name == "timestamp":
            cell = F.when(F.col("ts_us").isNotNull(), to_iso8601(F.col("ts_us")))
        elif name == "severity":
            cell = severity_name(F.col(name))
        elif name in ("source", *TEXTS):
            cell = F.col(name)
        elif name == "record_index":
            cell = F.col(name).cast("string")
        elif name == "pid":
            cell = F.when(F.col(name) >= 0, F.col(name).cast("string"))
        else:
            cell = F.when(F.col(name) != 0, F.col(name).cast("string"))
        cells.append(csv_quote(F.coalesce(cell, F.lit(""))))
    return F.array_join(F.array(*cells), ",")


def ndjson(events: DataFrame) -> DataFrame:
    return events.select(json_text().alias("value"))


def csv(events: DataFrame) -> DataFrame:
    return events.select(csv_text().alias("value"))


def write_ndjson(events: DataFrame, path: str) -> None:
    ndjson(events).write.text(path)


def write_csv(events: DataFrame, path: str) -> None:
    """CSV parts, each with the header as its first row. Cells are written as they are: the text sink quotes and trims nothing."""

    def headed(batches):
        first = True
        for batch in batches:
            if batch.num_rows and first:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([csv_header()], batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    csv(events).mapInArrow(headed, "value string").write.text(path)

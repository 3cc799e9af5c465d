"""CEF lines, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.functions import times
from emberlog.functions.text import let, parse_u32, parse_u64, trim, truncate
from emberlog.sources.common import diagnostic, events, no_diagnostic, string_fields

MOST_FIELD, MOST_PAIRS, MOST_MESSAGE = 1 << 16, 1024, 1 << 20
_FIELD = r"((?:[^|\\]|\\[|\\]|\\(?![|\\]))*+)"
_HEADER = rf"(?s)CEF:([0-9]*+)\|{_FIELD}\|{_FIELD}\|{_FIELD}\|{_FIELD}\|{_FIELD}\|{_FIELD}(?:\|(.*))?\z"
_KEY = "[A-Za-z0-9._-]"
#: key=value up to a space before another key=; an escape is never the start of one.
_PAIR = rf"(?s){_KEY}++=(?:\\[=\\nr]|(?! {_KEY}++=).)*+"
_NAMES = ("vendor", "product", "version_text", "signature", "name", "severity_text")


def _cut(c: Column, most: int) -> Column:
    return let(c, lambda x: F.when(F.octet_length(x) > most, F.substring(F.encode(x, "UTF-8"), 1, most).cast("string")).otherwise(x))


def unescape_value(c: Column) -> Column:
    r"""\= \\ \n \r; other backslashes stay."""
    parts = lambda x: F.regexp_extract_all(x, F.lit(r"(?s)\\[=\\nr]|[^\\]+|\\"), F.lit(0))
    one = lambda p: F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\=", "=").when(p == "\\\\", "\\").otherwise(p)
    return let(c, lambda x: F.when(x.contains("\\"), F.array_join(F.transform(parts(x), one), "")).otherwise(x))


def extensions(text: Column) -> Column:
    """array<struct<key, text>>, at most MOST_PAIRS. A word without = is passed over up to the next space."""
    step = rf"(?s)({_PAIR})|{_KEY}++(?!=)[^ ]*+|[^A-Za-z0-9._-]"
    found = F.filter(F.regexp_extract_all(text, F.lit(step), F.lit(1)), lambda p: p != "")
    pair = lambda p: F.struct(_cut(F.regexp_extract(p, rf"^({_KEY}+)=", 1), MOST_FIELD).alias("key"), _cut(unescape_value(F.regexp_extract(p, rf"(?s)^{_KEY}+=(.*)\z", 1)), MOST_FIELD).alias("text"))
    return F.transform(F.slice(found, 1, MOST_PAIRS), pair)


def parse(lines: DataFrame) -> DataFrame:
    """lines with the decoded record. status: ok, empty, malformed (no marker or separator) or truncated (too few fields)."""
    line = F.col("line")
    # The first marker decides; a later one is text.
    first = F.substring(line, F.greatest(F.instr(line, "CEF:"), F.lit(1)), F.length(line))
    rows = lines.withColumn("line_", first)
    header = "(?s)^" + _HEADER.removeprefix("(?s)")
    head = lambda k: _cut(F.regexp_replace(F.regexp_extract("line_", header, k), r"\\([|\\])", "$1"), MOST_FIELD)
    status = F.when(line == "", "empty").when(~F.col("line_").rlike(r"^CEF:[0-9]*+\|"), "malformed").when(~F.col("line_").rlike(header), "truncated").otherwise("ok")
    number = parse_u32(F.regexp_extract("line_", header, 1))
    made = {name: head(k + 2) for k, name in enumerate(_NAMES)}
    rows = rows.withColumns({"status": status, "cef_version": F.coalesce(number, F.lit(0)).cast("bigint"), **made})
    return rows.withColumn("extensions", extensions(_cut(F.regexp_extract("line_", header, 8), MOST_FIELD))).drop("line_")


def first_extension(key: str) -> Column:
    return F.get(F.filter("extensions", lambda e: e["key"] == key), F.lit(0))["text"]


def has_extension(key: str) -> Column:
    return F.exists("extensions", lambda e: e["key"] == key)


def receipt_time(text: Column, year: int = 1970) -> Column:
    """Digits are milliseconds since 1970; other texts any known time."""
    milliseconds = lambda n: F.when(n <= 9223372036854775, (n * 1000).cast("bigint"))
    return let(trim(text), lambda s: F.when(s.rlike("^[0-9]+\\z"), let(parse_u64(s), milliseconds)).otherwise(times.any_time(s, year)))


def to_events(lines: DataFrame, year: int = 1970) -> DataFrame:
    rows = parse(lines)
    ok = F.col("status") == "ok"
    vendor, product = trim(F.col("vendor")), trim(F.col("product"))
    of = lambda *keys: F.filter("extensions", lambda e: e["key"].isin(*keys))
    first = lambda *keys: F.get(F.filter(of(*keys), lambda e: e["text"] != ""), F.lit(0))["text"]
    port = lambda key: F.get(F.filter(F.transform(of(key), lambda e: F.coalesce(parse_u32(trim(e["text"])), F.lit(0))), lambda n: n != 0), F.lit(0))
    times_ = F.filter(F.transform(of("rt"), lambda e: receipt_time(e["text"], year)), lambda t: t.isNotNull())
    time = let(times_, lambda t: F.when(F.size(t) > 0, F.element_at(t, -1)))
    message = F.coalesce(F.when(F.size(of("msg")) > 0, F.element_at(of("msg"), -1)["text"]), F.col("name"))
    extra = [("cef.signatureId", "signature"), ("cef.name", "name"), ("cef.deviceVersion", "version_text")]
    head = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("text")) for k, c in extra)), lambda p: p["text"] != "")
    version = F.array(F.struct(F.lit("cef.version").alias("key"), F.lit("int").alias("kind"), F.col("cef_version").cast("string").alias("text")))
    good = lambda c: F.when(ok, c)
    values = {
        "ts_us": good(time),
        "severity": good(schema.from_cef(F.col("severity_text"))),
        "source": F.lit("unknown"),
        "record_index": F.col("line_no"),
        "provider": good(F.concat_ws(" ", F.nullif(vendor, F.lit("")), F.nullif(product, F.lit("")))),
        "app": good(product),
        "channel": good(product),
        "message": truncate(F.when(ok, message).when(F.col("status") == "empty", "").otherwise(F.col("line")), MOST_MESSAGE),
        "event_id": good(parse_u32(trim(F.col("signature")))),
        "src_ip": good(first("src", "dvc")),
        "dst_ip": good(first("dst")),
        "src_port": good(port("spt")),
        "dst_port": good(port("dpt")),
        "user": good(first("suser", "duser")),
        "fields": good(F.concat(string_fields(F.concat("extensions", head)), version)),
    }
    detail = F.when(F.col("status") == "truncated", "cef: fewer than seven header fields").when(F.instr("line", "CEF:") == 0, "cef: missing 'CEF:' marker").otherwise("cef: missing field separator after version")
    problem = F.when(F.col("status").isin("malformed", "truncated"), diagnostic("warn", "cef.line", detail, F.col("line_no"))).otherwise(no_diagnostic())
    return events(rows, values, problem)


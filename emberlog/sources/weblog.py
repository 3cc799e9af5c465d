"""Access logs in Common and Combined format, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.functions import times
from emberlog.functions.text import let, parse_u64, percent_decode, sanitize, split_whitespace, truncate
from emberlog.sources.common import diagnostic, events, no_diagnostic

MOST_LINE, MOST_FIELD, MOST_TARGET = 1 << 20, 1 << 16, 512
_GAP = r"[ \t\r\n\x0B\f]"
#: Quoted (a backslash takes the next character along), bracketed, or bare; what does not close runs to the end.
_TOKEN = rf'(?s)"(?:[^"\\]|\\.)*+(?:"|\\?\z)|\[[^\]]*+(?:\]|\z)|[^ \t\r\n\x0B\f"\[][^ \t\r\n\x0B\f]*+'


def tokens(line: Column) -> Column:
    """The fields of a line without their quotes and brackets."""
    raw = F.regexp_extract_all(F.substring(F.encode(line, "UTF-8"), 1, MOST_LINE).cast("string"), F.lit(_TOKEN), F.lit(0))
    quoted = lambda t: F.regexp_replace(F.regexp_replace(t, r'(?s)^"((?:[^"\\]|\\.)*+)"?', "$1"), r"(?s)\\(.)", "$1")
    plain = lambda t: F.when(t.startswith('"'), quoted(t)).when(t.startswith("["), F.regexp_replace(t, r"(?s)^\[([^\]]*+)\]?", "$1")).otherwise(t)
    cut = lambda p: let(p, lambda t: F.when(F.octet_length(t) > MOST_FIELD, F.substring(F.encode(t, "UTF-8"), 1, MOST_FIELD).cast("string")).otherwise(t))
    return F.transform(raw, lambda t: cut(plain(t)))


def request_line(text: Column) -> Column:
    """struct<method, target, version, valid>: three parts are a request, of more the middle ones are the target."""

    def request(parts: Column) -> Column:
        n = F.size(parts)
        part = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
        target = F.when(n == 2, part(F.lit(1))).when(n >= 3, F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), " ")).otherwise("")
        return F.struct(part(F.lit(0)).alias("method"), target.alias("target"), F.when(n >= 3, part(n - 1)).otherwise("").alias("version"), (n == 3).alias("valid"))

    return let(split_whitespace(text), request)


def decoded_path(target: Column) -> Column:
    """The target up to a query or fragment, percent-decoded."""
    return percent_decode(F.regexp_extract(target, "(?s)^[^?#]*", 0))


def parse(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, line) with the decoded record; blank lines are gone. status: ok or malformed."""
    rows = lines.where(~F.col("line").rlike(rf"^{_GAP}*\z")).withColumn("t", tokens(F.col("line")))
    n, at = F.size("t"), lambda k: F.coalesce(F.get("t", F.lit(k)), F.lit(""))
    undash = lambda c: F.when(c == "-", F.lit("")).otherwise(c)
    combined = n >= 9
    return rows.select(
        "file", "line_no", "line", F.when(n >= 5, "ok").otherwise("malformed").alias("status"),
        F.when(combined, "combined").otherwise("common").alias("format"),
        at(0).alias("client_ip"), undash(at(1)).alias("ident"), undash(at(2)).alias("user"), times.clf(at(3)).alias("ts_us"),
        request_line(at(4)).alias("request"),
        F.coalesce(let(parse_u64(at(5)), lambda n: F.when(n <= 0xFFFFFFFF, n)), F.lit(0)).cast("bigint").alias("http_status"), parse_u64(at(6)).alias("bytes"),
        F.when(combined, undash(at(7))).otherwise("").alias("referer"), F.when(combined, undash(at(8))).otherwise("").alias("user_agent"),
    )


def to_events(lines: DataFrame) -> DataFrame:
    """Records as events; a line without structure keeps its sanitised text."""
    rows = parse(lines)
    ok = F.col("status") == "ok"
    dash = lambda c: F.when(c == "", F.lit("-")).otherwise(c)
    message = F.concat(dash(F.col("request.method")), F.lit(" "), dash(truncate(F.col("request.target"), MOST_TARGET)), F.lit(" -> "), F.col("http_status").cast("string"))
    extra = F.array(*(F.struct(F.lit(c).alias("key"), F.lit("string").alias("kind"), F.col(c).alias("text")) for c in ("referer", "user_agent", "ident")))
    good = lambda c: F.when(ok, c)
    values = {
        "ts_us": good(F.col("ts_us")),
        "severity": good(schema.from_http(F.col("http_status"))),
        "source": F.lit("web-access"),
        "record_index": F.col("line_no"),
        "src_ip": good(F.col("client_ip")),
        "user": good(F.col("user")),
        "http_method": good(F.col("request.method")),
        "http_path": good(F.col("request.target")),
        "http_status": good(F.col("http_status")),
        "bytes": good(F.col("bytes")),
        "message": F.when(ok, message).otherwise(F.concat(F.lit("unparsed: "), truncate(sanitize(F.col("line")), 256))),
        "fields": good(F.filter(extra, lambda f: f["text"] != "")),
    }
    where = "weblog.parse_stream"
    problem = (
        F.when(~ok, diagnostic("warn", where, "too few fields for an access-log record", F.col("line_no")))
        .when(F.col("ts_us").isNull(), diagnostic("debug", where, "record has no parseable timestamp", F.col("line_no")))
        .otherwise(no_diagnostic())
    )
    return events(rows, values, problem)

"""Syslog lines of both dialects, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.functions import times
from emberlog.functions.text import let, parse_i64, truncate
from emberlog.sources.common import diagnostic, events, no_diagnostic, string_fields

MOST_ELEMENTS, MOST_PARAMS, MOST_MESSAGE = 256, 256, 1 << 20
#: A quoted value: escapes of " \ and ], any other backslash for itself.
_VALUE = r'(?:[^"\\]|\\["\\\]]|\\(?!["\\\]]))*+'
_PARAM = rf'([^= \]]*+)="({_VALUE})"'
_PARAM_ONLY = rf'[^= \]]*+="{_VALUE}"'
_ELEMENT = rf"\[[^ \]]++(?: *+{_PARAM_ONLY})*+ *+\] *+"
_DATA = rf"^(?:{_ELEMENT})++(?!\[)"
_BSD = r"^[A-Za-z]{3} [ 0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2}"
_HEADER = r"(?s)^[^ ]+ *([^ ]*) *([^ ]*) *([^ ]*) *([^ ]*) *([^ ]*) *(.*)$"


def _group(c: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(c, pattern, k)


def _groups(c: Column, pattern: str, n: int) -> Column:
    """The groups of a pattern that takes a whole text, the last one with the rest: one pass, cut at NULs put between them; texts with NULs of their own group by group."""
    marked = F.regexp_replace(c, pattern, "".join(f"${k}\x00" for k in range(1, n)) + f"${n}")
    return F.when(c.contains("\x00"), F.array(*(_group(c, pattern, k) for k in range(1, n + 1)))).otherwise(F.split(marked, "\x00", n))


def _denil(c: Column) -> Column:
    return F.when(c == "-", F.lit("")).otherwise(c)


def structured_data(text: Column) -> Column:
    """struct<status, elements: array<struct<id, params: array<struct<name, value>>>>, rest> of text at structured data."""
    unescape = lambda v: F.regexp_replace(v, r'\\(["\\\]])', "$1")
    one = lambda e: F.struct(
        F.regexp_extract(e, r"^\[([^ \]]+)", 1).alias("id"),
        F.transform(F.regexp_extract_all(F.regexp_replace(e, r"^\[[^ \]]+", ""), F.lit(_PARAM_ONLY), F.lit(0)), lambda p: F.struct(F.regexp_extract(p, r"^ *([^= \]]*)=", 1).alias("name"), unescape(F.regexp_extract(p, rf'^[^=]*="({_VALUE})"$', 1)).alias("value"))).alias("params"),
    )

    def read(found: Column) -> Column:
        elements = F.transform(F.regexp_extract_all(found, F.lit(_ELEMENT), F.lit(0)), one)
        too_many = lambda x: (F.size(x) > MOST_ELEMENTS) | F.exists(x, lambda e: F.size(e["params"]) > MOST_PARAMS)
        status = lambda x: F.when(text == "", "truncated").when(text.startswith("-"), "ok").when(found == "", "malformed").when(too_many(x), "limit-exceeded").otherwise("ok")
        rest = F.when(text.startswith("-"), F.substring(text, F.lit(2), F.length(text))).when(found != "", F.substring(text, F.length(found) + 1, F.length(text))).otherwise(text)
        return let(elements, lambda x: F.struct(status(x).alias("status"), x.alias("elements"), rest.alias("rest")))

    return let(F.regexp_extract(text, _DATA, 0), read)


def parse(lines: DataFrame, year: int = 1970) -> DataFrame:
    """lines (file, line_no, line) with the decoded message beside them."""
    line = F.col("line")
    number = _group(line, "^<([0-9]{1,3})>", 1)
    value = F.when(number != "", number.try_cast("int"))
    has = value.isNotNull() & (value <= 191)
    rows = lines.withColumns({"priority": F.when(has, value), "rest": F.regexp_replace(F.when(has, _after(line, F.length(number) + 2)).otherwise(line), "^ +", "")})
    rest = F.col("rest")
    new = rest.rlike("^[0-9]{1,2} ")
    rows = rows.withColumns(
        {
            "facility": F.floor(F.col("priority") / 8).cast("int"), "level": F.col("priority") % 8, "new": new,
            "head": F.when(new, _groups(rest, _HEADER, 6)),
            "stamped": rest.rlike(_BSD),
        }
    )
    body = F.when(F.col("stamped"), F.regexp_replace(_after(rest, F.lit(15)), "^ +", "")).otherwise(rest)
    rows = rows.withColumn("sd", F.when(F.col("new"), let(F.get("head", F.lit(5)), structured_data))).withColumn("body", body)
    rows = rows.withColumn("words", _groups(F.col("body"), r"(?s)^([^ ]*) *([^ ]*) *(.*)$", 3))
    rows = rows.withColumns({name: F.get("words", F.lit(k)) for k, name in enumerate(("b_host", "b_token", "b_message"))})
    rows = rows.withColumn("b_tag", F.regexp_replace("b_token", ":\\z", ""))
    tag = F.col("b_tag")
    tagged = F.col("b_token").endswith(":") | F.col("b_token").contains("[")
    in_brackets = tag.rlike(r"(?s)\[[^\[]*\]\z")
    head = lambda k: _denil(F.get("head", F.lit(k)))
    sd_ok = F.col("sd.status") == "ok"
    message = F.regexp_replace(F.when(sd_ok, F.col("sd.rest")).otherwise(F.get("head", F.lit(5))), "^ +", "")
    time_text = F.get("head", F.lit(0))
    return rows.select(
        "file", "line_no", "line", "priority", "facility", "level",
        F.when(F.col("new"), "rfc5424").otherwise("rfc3164").alias("flavor"),
        F.when(line == "", "empty").when(F.col("sd.status") == "limit-exceeded", "limit-exceeded").otherwise("ok").alias("status"),
        F.when(F.col("new"), F.when(~time_text.isin("", "-"), times.iso8601(time_text))).when(F.col("stamped"), times.bsd(F.substring(rest, 1, 15), year)).alias("ts_us"),
        F.when(F.col("new"), head(1)).otherwise(F.col("b_host")).alias("hostname"),
        F.when(F.col("new"), head(2)).when(tagged & in_brackets, F.regexp_replace(tag, r"(?s)\[[^\[]*\]\z", "")).when(tagged, tag).otherwise(F.col("b_token")).alias("app_name"),
        F.when(F.col("new"), head(3)).when(tagged & in_brackets, _group(tag, r"(?s)\[([^\[]*)\]\z", 1)).otherwise("").alias("proc_id"),
        F.when(F.col("new"), head(4)).otherwise("").alias("msg_id"),
        F.when(F.col("new") & sd_ok, F.col("sd.elements")).alias("structured_data"),
        F.when(F.col("new"), message).otherwise(F.col("b_message")).alias("message"),
    )


def _after(c: Column, n: Column) -> Column:
    return F.substring(c, (n + 1).cast("int"), F.length(c))


def to_events(lines: DataFrame, year: int = 1970) -> DataFrame:
    """Every line gives an event: an empty one a placeholder, one beyond the limits its raw text."""
    rows = parse(lines, year)
    ok = F.col("status") == "ok"
    pairs = F.flatten(F.transform("structured_data", lambda e: F.transform(e["params"], lambda p: F.struct(F.concat(e["id"], F.lit("."), p["name"]).alias("key"), p["value"].alias("text")))))
    good = lambda c: F.when(ok, F.col(c)).otherwise("")
    values = {
        "ts_us": F.when(ok, F.col("ts_us")),
        "severity": F.when(ok, schema.from_syslog(F.col("level"))),
        "source": F.lit("syslog"),
        "record_index": F.col("line_no"),
        "host": good("hostname"),
        "app": good("app_name"),
        "provider": good("app_name"),
        "pid": F.when(ok, parse_i64(F.col("proc_id"))),
        "message": truncate(F.when(F.col("status") == "limit-exceeded", F.col("line")).otherwise(good("message")), MOST_MESSAGE),
        "fields": F.when(ok & F.col("structured_data").isNotNull(), string_fields(pairs)),
    }
    problem = F.when(F.col("status") == "limit-exceeded", diagnostic("warn", "syslog.line", "structured-data: too many elements or params", F.col("line_no"))).otherwise(no_diagnostic())
    return events(rows, values, problem)

"""The canonical event: one wide row whatever the source, and the severity scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "array<struct<key:string,kind:string,text:string>>"
#: Column, type and what stands for "absent". Text is never null.
COLUMNS: dict[str, tuple[str, object]] = {
    "ts_us": ("bigint", None),
    "severity": ("tinyint", 8),
    "source": ("string", "unknown"),
    "record_index": ("bigint", 0),
    "host": ("string", ""),
    "app": ("string", ""),
    "pid": ("bigint", -1),
    "user": ("string", ""),
    "src_ip": ("string", ""),
    "dst_ip": ("string", ""),
    "src_port": ("bigint", 0),
    "dst_port": ("bigint", 0),
    "http_method": ("string", ""),
    "http_path": ("string", ""),
    "http_status": ("bigint", 0),
    "bytes": ("decimal(20,0)", 0),
    "event_id": ("bigint", 0),
    "channel": ("string", ""),
    "provider": ("string", ""),
    "message": ("string", ""),
    "fields": (FIELDS, None),
}
#: Names of severities by number, and words for them.
SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug", "unknown")
SEVERITY_WORDS = {
    "emerg": 0, "emergency": 0, "panic": 0, "alert": 1, "crit": 2, "critical": 2, "err": 3, "error": 3, "warn": 4, "warning": 4,
    "notice": 5, "info": 6, "information": 6, "informational": 6, "debug": 7, "trace": 7, "verbose": 7,
}
#: Syslog facilities by number.
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp",
    "ntp", "audit", "alert", "clock", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)


def no_fields() -> Column:
    return F.array().cast(FIELDS)


def event(rows: DataFrame, values: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Canonical events from rows; columns without a value are absent. `keep` names columns that stay."""
    made = []
    for name, (kind, absent) in COLUMNS.items():
        value = values.get(name)
        if name == "fields":
            value = F.coalesce(value, no_fields()) if value is not None else no_fields()
        elif value is None:
            value = F.lit(absent)
        elif absent is not None:
            value = F.coalesce(value.cast(kind), F.lit(absent))
        made.append(value.cast(kind).alias(name))
    return rows.select(*made, *(keep or []))


def named(texts: tuple[str, ...], number: Column, other: str = "unknown") -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, texts)), number.cast("int")), F.lit(other))


def severity_name(severity: Column) -> Column:
    return named(SEVERITIES, severity)


def facility_name(facility: Column) -> Column:
    return named(FACILITIES, facility)


def from_syslog(number: Column) -> Column:
    return F.when(number.between(0, 7), number).otherwise(8).cast("tinyint")


def from_word(word: Column) -> Column:
    from emberlog.functions.text import ascii_lower, trim

    table = F.create_map(*(F.lit(x) for pair in SEVERITY_WORDS.items() for x in pair))
    return F.coalesce(F.element_at(table, ascii_lower(trim(word))), F.lit(8)).cast("tinyint")


def from_windows(level: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, (8, 2, 3, 4, 6, 7))), level.cast("int")), F.lit(8)).cast("tinyint")


def from_http(status: Column) -> Column:
    return F.when(status.between(500, 599), 3).when(status.between(400, 499), 4).otherwise(6).cast("tinyint")


def from_cef(text: Column) -> Column:
    """Numbers 0 to 10 by ranges, or words; larger numbers are critical."""
    from emberlog.functions.text import ascii_lower, let, trim


    def scale(word: Column) -> Column:
        number = F.when(F.length(word) <= 18, word.try_cast("bigint")).otherwise(F.lit(1 << 40))
        by_number = F.when(number <= 3, 6).when(number <= 6, 4).when(number <= 8, 3).otherwise(2)
        by_word = F.when(word == "low", 6).when(word == "medium", 4).when(word == "high", 3).when(word.isin("very-high", "critical"), 2).otherwise(8)
        return F.when(word.rlike("^[0-9]+$"), by_number).otherwise(by_word).cast("tinyint")

    return let(ascii_lower(trim(text)), scale)


def at_least_as_severe(a: Column, b: Column) -> Column:
    """a is known and as severe as b; everything known is as severe as unknown."""
    return (a < 8) & ((b == 8) | (a <= b))


def error_or_worse() -> Column:
    return F.col("severity") <= 3

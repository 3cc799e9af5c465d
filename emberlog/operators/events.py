"""Values of one event: summary line, message shape, signature, actor and intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.text import ascii_lower, sanitize, truncate
from emberlog.functions.times import to_iso8601
from emberlog.schema import severity_name

SHAPE_BYTES = 120
#: What the text of a failed or a successful login contains, event numbers, and outcomes.
FAILED_TEXTS = ("failed password", "authentication failure", "failed login", "invalid user")
PASSED_TEXTS = ("accepted password", "session opened", "login successful")
FAILED_EVENT, PASSED_EVENT = 4625, 4624
OUTCOME_FIELDS, FAILED_OUTCOMES, PASSED_OUTCOMES = ("outcome", "result", "status"), ("failure", "failed", "denied"), ("success",)


def field(name: str) -> Column:
    """The text of a dynamic field, null if there is none."""
    return F.get(F.filter("fields", lambda f: f["key"] == name), F.lit(0))["text"]


def message_shape(message: Column) -> Column:
    """Digit runs as #, at most 120 bytes."""
    return F.substring(F.encode(F.regexp_replace(message, "[0-9]+", "#"), "UTF-8"), 1, SHAPE_BYTES).cast("string")


def signature() -> Column:
    """source|provider or app|event number, or method and status, or message shape."""
    origin = F.when(F.col("provider") != "", F.col("provider")).otherwise(F.col("app"))
    what = (
        F.when(F.col("event_id") != 0, F.col("event_id").cast("string"))
        .when(F.col("http_status") != 0, F.concat("http_method", F.lit(" "), F.col("http_status").cast("string")))
        .otherwise(message_shape(F.col("message")))
    )
    return F.concat("source", F.lit("|"), origin, F.lit("|"), what)


def summary() -> Column:
    """One line: time, severity and source, then what is there, two spaces between."""
    some = lambda c, label="": F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    request = F.concat("http_method", F.lit(" "), truncate(F.col("http_path"), 80), F.lit(" "), F.col("http_status").cast("string"))
    return F.concat_ws(
        "  ",
        to_iso8601(F.col("ts_us")),
        severity_name(F.col("severity")),
        F.col("source"),
        some("host", "host="),
        some("app", "app="),
        F.when(F.col("event_id") != 0, F.concat(F.lit("id="), F.col("event_id").cast("string"))),
        some("src_ip", "src="),
        F.when(F.col("http_status") != 0, request),
        F.when(F.col("message") != "", truncate(sanitize(F.col("message")), 160)),
    )


def actor() -> Column:
    """Source address, else user, else host."""
    named = [F.nullif(F.col(c), F.lit("")) for c in ("src_ip", "user", "host")]
    return F.coalesce(*named, F.lit(""))


def _any_text(texts: tuple[str, ...]) -> Column:
    low, found = ascii_lower(F.col("message")), F.lit(False)
    for t in texts:
        found = found | low.contains(t)
    return found


def _outcome() -> Column:
    return ascii_lower(F.coalesce(*(field(n) for n in OUTCOME_FIELDS), F.lit("")))


def is_failed_auth() -> Column:
    return _any_text(FAILED_TEXTS) | ((F.col("source") == "win-event") & (F.col("event_id") == FAILED_EVENT)) | _outcome().isin(*FAILED_OUTCOMES)


def is_successful_auth() -> Column:
    return _any_text(PASSED_TEXTS) | ((F.col("source") == "win-event") & (F.col("event_id") == PASSED_EVENT)) | _outcome().isin(*PASSED_OUTCOMES)

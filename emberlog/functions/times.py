"""Times as microseconds since 1970 in UTC (bigint, null = none), independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.text import ascii_lower, let, split_whitespace, trim

#: Fixed values.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SECOND = 1_000_000


def floor_div(a: Column, b: int | Column) -> Column:
    """bigint: a / b rounded down, exact for all 64-bit values."""
    b = b if isinstance(b, Column) else F.lit(b).cast("bigint")
    return F.call_function("div", a.cast("bigint") - F.pmod(a.cast("bigint"), b), b)


def _int(c: Column) -> Column:
    return F.when(F.length(c) <= 18, F.when(c.rlike("^[0-9]+\\z"), c.try_cast("bigint"))).otherwise(F.lit(1 << 60))


def days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar; a day beyond the month runs over."""
    y = year - F.when(month <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468).cast("bigint")


def micros(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, micro: Column | None = None) -> Column:
    second = F.when(second == 60, 59).otherwise(second)
    total = ((days(year, month, day) * 24 + hour) * 60 + minute) * 60 + second
    return total * SECOND + (micro if micro is not None else F.lit(0))


def month_number(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), ascii_lower(name)), F.lit(0).cast("bigint"))


def iso8601(c: Column) -> Column:
    """Date, or date and time; up to six digits of a second; Z, an offset or nothing (UTC); what follows is ignored."""
    return let(trim(c), _iso8601)


def _iso8601(s: Column) -> Column:
    """All fields stand at fixed places, but for the offset after the digits of a second."""
    number = lambda at, n: F.substring(s, at, n).try_cast("bigint")
    day = lambda v: (F.unix_date(F.make_date(v[0].cast("int"), v[1].cast("int"), F.lit(1))).cast("bigint") + v[2] - 1) * (86_400 * SECOND)
    clock = lambda v: F.when((v[3] <= 23) & (v[4] <= 59) & (v[5] <= 60), ((v[3] * 60 + v[4]) * 60 + F.least(v[5], F.lit(59))) * SECOND)
    timed = lambda v: day(v) + clock(v) + let(F.regexp_extract(s, r"^.{19}\.([0-9]*)", 1), lambda f: F.rpad(F.substring(f, 1, 6), 6, "0").try_cast("bigint") - let(_after_second(s, f), _offset))
    whole = s.rlike(r"^.{10}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}")
    fields = F.array(number(1, 4), number(6, 2), number(9, 2), number(12, 2), number(15, 2), number(18, 2))
    found = let(fields, lambda v: F.when(v[1].between(1, 12) & v[2].between(1, 31), F.when(whole, timed(v)).when(~s.rlike(r"^.{10}[Tt ]"), day(v))))
    return F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), found)


def _after_second(s: Column, fraction: Column) -> Column:
    return F.substring(s, F.when(F.substring(s, 20, 1) == ".", F.length(fraction) + 21).otherwise(20), F.length(s))


def _offset(tail: Column) -> Column:
    """Microseconds east of UTC; null for a sign without hours and minutes."""
    digits = F.replace(F.substring(tail, 2, 5), F.lit(":"), F.lit(""))
    value = (F.substring(digits, 1, 2).try_cast("bigint") * 60 + F.substring(digits, 3, 2).try_cast("bigint")) * (60 * SECOND)
    return F.when(tail.rlike("^[+-][0-9]{2}:?[0-9]{2}"), F.when(tail.startswith("-"), -value).otherwise(value)).when(~tail.rlike("^[+-]"), F.lit(0).cast("bigint"))


def bsd(c: Column, year: int | Column = 1970) -> Column:
    """Mmm d hh:mm:ss of a given year."""
    return let(split_whitespace(c), lambda parts: _bsd(parts, year))


def _bsd(parts: Column, year: int | Column) -> Column:
    year = year if isinstance(year, Column) else F.lit(year)
    hms = lambda h: F.when(F.size(h) == 3, F.array(month_number(parts[0]), _int(parts[1]), *(_int(h[k]) for k in range(3))))
    good = lambda v: v[0].isNotNull() & v[1].between(1, 31) & (v[2] <= 23) & (v[3] <= 59) & (v[4] <= 60)
    found = let(let(F.split(parts[2], ":", -1), hms), lambda v: F.when(good(v), micros(year, *(v[k] for k in range(5)))))
    return F.when(F.size(parts) >= 3, found)


def clf(c: Column) -> Column:
    """dd/Mmm/yyyy:hh:mm:ss with an optional +hhmm, in brackets or not."""
    return let(split_whitespace(F.regexp_replace(F.regexp_replace(trim(c), "^\\[", ""), "\\]\\z", "")), _clf)


def _clf(parts: Column) -> Column:
    date = lambda w: let(F.split(w[0], "/", -1), lambda d: F.when(F.size(d) == 3, F.array(_int(d[2]), month_number(d[1]), _int(d[0]), *(_int(w[k]) for k in (1, 2, 3)))))
    good = lambda v: v[1].isNotNull() & v[2].between(1, 31) & (v[0] <= 200_000) & (v[3] <= 23) & (v[4] <= 59) & (v[5] <= 60)
    value = lambda z: (F.substring(z, 2, 2).try_cast("bigint") * 60 + F.substring(z, 4, 2).try_cast("bigint")) * (60 * SECOND)
    offset = let(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), lambda z: F.when(z.rlike("^[+-][0-9]{4}\\z"), F.when(z.startswith("-"), -value(z)).otherwise(value(z))).otherwise(F.lit(0).cast("bigint")))
    fields = let(F.split(F.get(parts, F.lit(0)), ":", -1), lambda w: F.when(F.size(w) == 4, date(w)))
    return let(fields, lambda v: F.when(good(v), micros(*(v[k] for k in range(6))) - offset))


def filetime(ticks: Column) -> Column:
    """100-nanosecond ticks since 1601."""
    return floor_div(ticks, 10) - F.lit(11_644_473_600 * SECOND)


def any_time(c: Column, year: int | Column = 1970) -> Column:
    """The first of ISO 8601, CLF, BSD and 9 to 11 digits of epoch seconds that fits."""
    seconds = lambda s: F.when(s.rlike("^[0-9]{9,11}\\z"), s.try_cast("bigint") * SECOND)
    return let(trim(c), lambda s: F.coalesce(_iso8601(s), clf(s), bsd(s, year), seconds(s)))


def to_iso8601(ts: Column) -> Column:
    """yyyy-mm-ddThh:mm:ss.uuuuuuZ, or `unknown`; years beyond 9999 have no sign."""
    whole = F.lit(86_400 * SECOND)
    rest = F.pmod(ts, whole)
    date = F.regexp_replace(F.date_from_unix_date(floor_div(ts, whole).cast("int")).cast("string"), "^[+]", "")
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    clock = [two(F.floor(rest / (3600 * SECOND))), two(F.floor(rest / (60 * SECOND)) % 60), two(F.floor(rest / SECOND) % 60)]
    text = F.concat(date, F.lit("T"), F.concat_ws(":", *clock), F.lit("."), F.lpad((rest % SECOND).cast("string"), 6, "0"), F.lit("Z"))
    return F.when(ts.isNull(), F.lit("unknown")).otherwise(text)


def leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_month(year: Column, month: Column) -> Column:
    plain = F.get(F.array(*map(F.lit, (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31))), (month - 1).cast("int"))
    return plain + F.when((month == 2) & leap_year(year), 1).otherwise(0)



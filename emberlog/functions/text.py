"""Text functions with ASCII and byte semantics, as Columns that stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES, _SPACE_CHARS = r"[ \t\r\n\x0B\f]", " \t\r\n\x0b\f"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row: a bound variable is never inlined, so nested expressions don't multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    """Only A to Z change, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def iequals(a: Column, b: Column) -> Column:
    return ascii_lower(a) == ascii_lower(b)


def is_space(c: Column) -> Column:
    return c.rlike(f"^{SPACES}$")


def is_digit(c: Column) -> Column:
    return c.rlike("^[0-9]$")


def is_hex(c: Column) -> Column:
    return c.rlike("^[0-9A-Fa-f]$")


def is_alpha(c: Column) -> Column:
    return c.rlike("^[A-Za-z]$")


def is_alnum(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9]$")


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE_CHARS))


def trim_left(c: Column) -> Column:
    return F.ltrim(c, F.lit(_SPACE_CHARS))


def trim_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(_SPACE_CHARS))


def starts_with(c: Column, part: str) -> Column:
    return c.startswith(part)


def ends_with(c: Column, part: str) -> Column:
    return c.endswith(part)


def contains(c: Column, part: str) -> Column:
    return c.contains(part)


def split(c: Column, mark: str, skip_empty: bool = False, max_splits: int = 0) -> Column:
    """Pieces between marks; with max_splits, the last piece holds the rest."""
    import re

    pieces = F.split(c, "\\Q" + mark + "\\E" if re.search(r"\W", mark) else mark, max_splits + 1 if max_splits else -1)
    return F.filter(pieces, lambda p: p != "") if skip_empty else pieces


def split_whitespace(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACES}+", -1), lambda p: p != "")


def split_lines(c: Column) -> Column:
    """Lines end at LF; a CR before it goes; no empty line after the last LF. A lone CR ends nothing."""
    lines = F.split(c, "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return F.transform(lines, lambda x: F.regexp_replace(x, "\\r\\z", ""))


def join(parts: Column, mark: str) -> Column:
    return F.array_join(parts, mark)


def replace_all(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new)) if old else c


def parse_u64(c: Column) -> Column:
    """decimal(20,0) of a run of digits within 64 bits, else null."""
    most = F.lit("18446744073709551615").cast("decimal(20,0)")
    digits = lambda x: F.when(x.rlike("^[0-9]+\\z"), F.regexp_replace(x, "^0+(?=[0-9])", ""))
    number = lambda d: F.when(F.length(d) <= 20, d.try_cast("decimal(20,0)"))
    return let(c, lambda x: let(digits(x), lambda d: let(number(d), lambda n: F.when(n <= most, n))))


def parse_i64(c: Column) -> Column:
    """bigint of digits with an optional sign, else null."""
    return F.when(c.rlike("^[+-]?[0-9]+\\z"), c.try_cast("bigint"))


def parse_u32(c: Column) -> Column:
    """bigint of a run of digits, clamped to 32 bits; null if not a 64-bit number."""
    return let(parse_u64(c), lambda n: F.when(n.isNotNull(), F.least(n, F.lit(0xFFFFFFFF).cast("decimal(20,0)"))).cast("bigint"))


def truncate(c: Column, most: int) -> Column:
    """At most so many bytes, the last three of them dots."""

    def cut(x: Column) -> Column:
        raw = F.encode(x, "UTF-8")
        short = F.substring(raw, 1, most) if most <= 3 else F.concat(F.substring(raw, 1, most - 3), F.encode(F.lit("..."), "UTF-8"))
        return F.when(F.octet_length(x) > most, short.cast("string")).otherwise(x)

    return let(c, cut)


def sanitize(c: Column) -> Column:
    """Tabs and line ends as \\t \\n \\r, other bytes outside printable ASCII as \\xNN."""
    bytes_ = F.regexp_extract_all(F.lower(F.hex(F.encode(c, "UTF-8"))), F.lit("(..)"), F.lit(1))
    shown = lambda h: (
        F.when(h == "09", F.lit("\\t")).when(h == "0a", F.lit("\\n")).when(h == "0d", F.lit("\\r")).when((h >= "20") & (h < "7f"), F.unhex(h).cast("string")).otherwise(F.concat(F.lit("\\x"), h))
    )
    return F.when(c.rlike("^[ -~]*\\z"), c).otherwise(F.array_join(F.transform(bytes_, shown), ""))


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def from_hex(c: Column) -> Column:
    """binary; null for an odd number of digits or others than hex."""
    return F.when(c.rlike("^(?:[0-9A-Fa-f]{2})*\\z"), F.unhex(c))


def percent_decode(c: Column) -> Column:
    """%XX as bytes, + as a space; a percent sign without two hex digits stays."""
    parts = F.regexp_extract_all(c, F.lit("(?s)%[0-9A-Fa-f]{2}|\\+|[^%+]+|%"), F.lit(0))
    raw = lambda p: F.when(p == "+", F.lit("20")).when(p.rlike("^%.."), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8")))
    return F.when(c.rlike("[%+]"), F.unhex(F.array_join(F.transform(parts, raw), "")).cast("string")).otherwise(c)


def base64_decode(c: Column) -> Column:
    """binary; white space is ignored, text ends at =, a single left-over digit or a foreign character gives null."""
    digits = F.regexp_extract(F.regexp_replace(c, f"{SPACES}+", ""), "^[^=]*", 0)
    left = F.length(digits) % 4
    padded = F.rpad(digits, (F.length(digits) + F.when(left > 0, 4 - left).otherwise(0)).cast("int"), F.lit("="))
    return F.when(digits.rlike("^[A-Za-z0-9+/]*\\z") & (left != 1), F.when(digits == "", F.lit(b"")).otherwise(F.unbase64(padded)))


def valid_utf8(c: Column) -> Column:
    return F.is_valid_utf8(c)


def utf16le(c: Column) -> Column:
    """Text of little-endian UTF-16 bytes; lone surrogates become U+FFFD, a last odd byte is ignored."""
    return F.pandas_udf(_utf16le, "string")(c)


def _utf16le(raw):
    return raw.map(lambda b: None if b is None else utf16le_text(bytes(b)))


_utf16le.__annotations__ = {}


def utf16le_text(raw: bytes) -> str:
    text = raw[: len(raw) // 2 * 2].decode("utf-16-le", "surrogatepass")
    return "".join("�" if "\ud800" <= ch <= "\udfff" else ch for ch in text)

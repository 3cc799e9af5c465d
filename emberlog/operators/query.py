"""The filter language, compiled to one Column.

    severity<=error AND host~"web" OR fields.x!=1

Predicates are joined strictly from left to right, without precedence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import ascii_lower, parse_i64
from emberlog.operators.events import field as dynamic_field
from emberlog.schema import SEVERITY_WORDS, severity_name

MOST_PREDICATES, MOST_TOKEN = 256, 4096
UNKNOWN_RANK = 1000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
OPERATORS = ("!=", "!~", "<=", ">=", "=", "~", "<", ">")
#: Built-in names and the columns behind them.
TEXTS = {n: n for n in ("host", "app", "user", "src_ip", "dst_ip", "channel", "provider", "message")} | {"method": "http_method", "path": "http_path"}
NUMBERS = {n: n for n in ("src_port", "dst_port", "event_id")} | {"status": "http_status"}
_FIELD, _SPACE = re.compile(r"[A-Za-z0-9_.\[\]]+"), re.compile(r"[ \t\r\n\v\f]*")
_WORD = re.compile(r"[^ \t\r\n\v\f]+")


class FilterError(ValueError):
    """A filter text that does not parse."""


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class Filter:
    predicates: tuple[Predicate, ...]
    joins: tuple[str, ...]  # "and" or "or" between neighbours

    def column(self) -> Column:
        if not self.predicates:
            return F.lit(True)
        whole = condition(self.predicates[0])
        for join, p in zip(self.joins, self.predicates[1:], strict=True):
            whole = (whole & condition(p)) if join == "and" else (whole | condition(p))
        return whole


def parse(text: str) -> Filter:
    """Raises FilterError for text that is no filter; an empty text matches everything."""
    at = _SPACE.match(text, 0).end()
    predicates: list[Predicate] = []
    joins: list[str] = []
    while at < len(text):
        if predicates:
            word = _WORD.match(text, at)
            join = word.group().lower()
            if join not in ("and", "or"):
                raise FilterError(f"expected AND or OR at {at}")
            joins.append(join)
            at = _SPACE.match(text, word.end()).end()
        if len(predicates) >= MOST_PREDICATES:
            raise FilterError("too many predicates")
        name = _FIELD.match(text, at)
        if not name:
            raise FilterError(f"expected a field name at {at}")
        at = _SPACE.match(text, name.end()).end()
        op = next((o for o in OPERATORS if text.startswith(o, at)), None)
        if op is None:
            raise FilterError(f"expected an operator at {at}")
        value, at = _value(text, _SPACE.match(text, at + len(op)).end())
        if len(name.group()) > MOST_TOKEN or len(value) > MOST_TOKEN:
            raise FilterError("token too long")
        predicates.append(Predicate(name.group(), op, value))
        at = _SPACE.match(text, at).end()
    return Filter(tuple(predicates), tuple(joins))


def _value(text: str, at: int) -> tuple[str, int]:
    if at >= len(text):
        raise FilterError("expected a value at the end")
    if text[at] != '"':
        word = _WORD.match(text, at)
        return word.group(), word.end()
    out, at = [], at + 1
    while at < len(text) and text[at] != '"':
        at += text[at] == "\\" and at + 1 < len(text)
        out.append(text[at])
        at += 1
    if at >= len(text):
        raise FilterError("unterminated quoted value")
    return "".join(out), at + 1


def _integer(text: str) -> int | None:
    if not re.fullmatch(r"[+-]?[0-9]+", text):
        return None
    n = int(text)
    return n if -(1 << 63) <= n < 1 << 63 else None


def _rank(text: str) -> int:
    """The number of a severity word or number; greater is less severe, unknown last."""
    n = _integer(text)
    if n is None:
        n = SEVERITY_WORDS.get(text.strip(" \t\r\n\v\f").lower(), 8)
    return 0 if n < 0 else UNKNOWN_RANK if n >= 8 else n


def _compare(op: str, left: Column, right: Column) -> Column:
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def condition(p: Predicate) -> Column:
    """One predicate. A built-in text that is empty gives way to a dynamic field of that name; numbers never do."""
    name, dynamic = p.field.lower(), dynamic_field(p.field)
    own = {"severity": severity_name(F.col("severity")), "source": F.col("source")}.get(name)
    if name in NUMBERS:
        own = F.col(NUMBERS[name]).cast("string")
    elif name in TEXTS:
        own = F.nullif(F.col(TEXTS[name]), F.lit(""))
    text = dynamic if own is None else F.coalesce(own, dynamic) if name in TEXTS else own
    low, value = ascii_lower(F.coalesce(text, F.lit(""))), p.value.translate(_LOWER)
    if p.op in ("=", "!="):
        return (low == value) if p.op == "=" else (low != value)
    if p.op in ("~", "!~"):
        return low.contains(value) if p.op == "~" else ~low.contains(value)
    wanted = _integer(p.value)
    if name == "severity":
        # As a magnitude: emergency is greatest, so ranks change signs.
        rank = F.when(F.col("severity") >= 8, UNKNOWN_RANK).otherwise(F.col("severity").cast("int"))
        return _compare(p.op, -rank, F.lit(-_rank(p.value)))
    if name in NUMBERS and wanted is not None:
        return _compare(p.op, F.col(NUMBERS[name]), F.lit(wanted))
    found = _compare(p.op, text, F.lit(p.value))
    if wanted is not None and name not in NUMBERS and name != "source":
        number = parse_i64(dynamic)
        by_number = F.when(number.isNotNull(), _compare(p.op, number, F.lit(wanted))).otherwise(_compare(p.op, dynamic, F.lit(p.value)))
        found = by_number if own is None else F.when(own.isNotNull(), _compare(p.op, own, F.lit(p.value))).otherwise(by_number)
    return F.coalesce(found, F.lit(False))


def where(events: DataFrame, text: str) -> DataFrame:
    return events.where(parse(text).column())



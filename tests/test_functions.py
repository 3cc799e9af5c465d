"""Text and time functions against plain Python."""

import base64
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.functions import text as T
from emberlog.functions import times


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'binary' if isinstance(v, bytes) else 'bigint'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-03-09T11:22:33.456Z", "2024-03-09T11:22:33.456000Z"),
        ("2024-03-09 11:22:33+02:00", "2024-03-09T09:22:33.000000Z"),
        ("2024-02-30", "2024-03-01T00:00:00.000000Z"),
        ("2024-02-29T23:59:60Z", "2024-02-29T23:59:59.000000Z"),
        ("2024-01-01T00:00:00.1234567 rest", "2024-01-01T00:00:00.123456Z"),
        ("2024-01-01x", "2024-01-01T00:00:00.000000Z"),
        ("2024-13-01", "unknown"), ("2024-01-01T24:00:00", "unknown"), ("2024-01-01T1:00:00", "unknown"), ("", "unknown"), ("2024-01-01T00:00:00+1", "unknown"),
    ],
)
def test_iso(spark, text, want):
    assert one(spark, times.to_iso8601(times.iso8601(F.col("s"))), s=text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("[10/Oct/2000:13:55:36 -0700]", "2000-10-10T20:55:36.000000Z"), ("10/oct/2000:13:55:36", "2000-10-10T13:55:36.000000Z"),
        ("Oct  1 02:03:04", "1970-10-01T02:03:04.000000Z"), ("1709983354", "2024-03-09T11:22:34.000000Z"), ("12345678", "unknown"), ("32/Oct/2000:13:55:36", "unknown"),
    ],
)
def test_any(spark, text, want):
    assert one(spark, times.to_iso8601(times.any_time(F.col("s"))), s=text) == want


def test_calendar_against_python(spark):
    r = random.Random(1)
    rows = [(r.randrange(-62135596800, 253402300800) * 1_000_000 + r.randrange(10**6),) for _ in range(500)]
    for row in spark.createDataFrame(rows, "us bigint").select("us", times.to_iso8601(F.col("us")).alias("t"), times.iso8601(times.to_iso8601(F.col("us"))).alias("back")).collect():
        want = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=row.us)
        assert row.t == want.strftime("%Y-%m-%dT%H:%M:%S.%fZ").rjust(27, "0") and row.back == row.us


def test_filetime(spark):
    assert one(spark, times.filetime(F.col("n")), n=116444736000000000 + 12_345_678) == 1_234_567


@pytest.mark.parametrize("text", ["", "a b", "é\t\n\r\x01", "plain", "\x7f~"])
def test_sanitize(spark, text):
    def shown(b):
        return {9: "\\t", 10: "\\n", 13: "\\r"}.get(b) or (chr(b) if 32 <= b < 127 else f"\\x{b:02x}")

    assert one(spark, T.sanitize(F.col("s")), s=text) == "".join(map(shown, text.encode()))


def test_truncate_counts_bytes(spark):
    assert one(spark, T.truncate(F.col("s"), 7), s="ééééé") == "éé..."
    assert one(spark, T.truncate(F.col("s"), 3), s="abcdef") == "abc"
    assert one(spark, T.truncate(F.col("s"), 6), s="abcdef") == "abcdef"


@pytest.mark.parametrize("text, want", [("a%20b+c%zz%", "a b c%zz%"), ("%41", "A"), ("", ""), ("%4", "%4")])
def test_percent(spark, text, want):
    assert one(spark, T.percent_decode(F.col("s")), s=text) == want


@pytest.mark.parametrize("text, want", [("aGk=", b"hi"), ("a G\nk", b"hi"), ("", b""), ("aGk=!!", b"hi"), ("a", None), ("a!", None)])
def test_base64(spark, text, want):
    got = one(spark, T.base64_decode(F.col("s")), s=text)
    assert (bytes(got) if got is not None else None) == want
    assert base64.b64encode(b"hi") == b"aGk="


def test_numbers(spark):
    assert one(spark, T.parse_u64(F.col("s")), s="18446744073709551615") == 18446744073709551615
    assert one(spark, T.parse_u64(F.col("s")), s="18446744073709551616") is None
    assert one(spark, T.parse_u32(F.col("s")), s="x") is None
    assert one(spark, T.parse_i64(F.col("s")), s="-9223372036854775808") == -(1 << 63)
    assert one(spark, T.parse_i64(F.col("s")), s="9223372036854775808") is None
    assert one(spark, T.parse_i64(F.col("s")), s=" 1") is None


def test_texts(spark):
    assert one(spark, T.ascii_lower(F.col("s")), s="ÀBc") == "Àbc"
    assert one(spark, T.split_lines(F.col("s")), s="a\r\nb\rc\n\nd\n") == ["a", "b\rc", "", "d"]
    assert one(spark, T.trim(F.col("s")), s=" \t\x0bx y\f\r\n") == "x y"
    assert one(spark, T.from_hex(F.col("s")), s="abc") is None
    assert one(spark, T.utf16le(F.col("s")), s="a\ud83d".encode("utf-16-le", "surrogatepass") + b"x") == "a�"
    assert one(spark, T.split(F.col("s"), "|", max_splits=1), s="a|b|c") == ["a", "b|c"]


@pytest.mark.parametrize("text, want", [("", 8), ("0", 6), ("5", 4), ("8", 3), ("10", 2), ("99999999999999999999", 2), ("Very-High", 2), ("medium", 4), ("odd", 8)])
def test_cef_severity(spark, text, want):
    assert one(spark, schema.from_cef(F.col("s")), s=text) == want


def test_severities(spark):
    assert one(spark, schema.from_word(F.col("s")), s=" WARNING ") == 4
    assert [one(spark, schema.from_windows(F.col("n")), n=k) for k in range(7)] == [8, 2, 3, 4, 6, 7, 8]
    assert [one(spark, schema.from_http(F.col("n")), n=k) for k in (0, 200, 404, 503)] == [6, 6, 4, 3]
    assert one(spark, schema.facility_name(F.col("n")), n=4) == "auth" and one(spark, schema.facility_name(F.col("n")), n=30) == "unknown"

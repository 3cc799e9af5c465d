"""Windows event log files: chunks cut by Spark, records and binary XML decoded chunk by chunk in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog import schema
from emberlog.functions import times
from emberlog.functions.text import parse_u64, trim, utf16le_text
from emberlog.sources.common import DIAGNOSTIC, diagnostic, events, string_fields

#: Layout of files, chunks and records.
FILE_MAGIC, CHUNK_MAGIC, RECORD_MARK = b"ElfFile\x00", b"ElfChnk\x00", 0x2A2A
FILE_HEADER, CHUNK, CHUNK_HEADER, RECORD_HEADER, RECORD_LEAST, FREE_OFFSET = 4096, 65_536, 512, 24, 28, 48
MOST_CHUNKS, MOST_RECORDS = 4096, 1 << 20
MOST_DEPTH, MOST_FIELDS, MOST_TEMPLATES, MOST_CHARS, MOST_TOKENS = 64, 4096, 1024, 1 << 16, 1 << 22


class Short(Exception):
    """A read beyond the end."""


class Cursor:
    """Little-endian reads within [at, end) of a buffer."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, min(end, len(data))

    def left(self) -> int:
        return self.end - self.at

    def take(self, n: int) -> bytes:
        if n > self.left():
            raise Short
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def text(self) -> str:
        """A count of UTF-16 units and as many of them as there are."""
        n = min(self.number(2), MOST_CHARS, self.left() // 2)
        return utf16le_text(self.take(2 * n))


def _integer(size: int, signed: bool) -> Callable[[bytes], str]:
    return lambda b: str(int.from_bytes(b[:size], "little", signed=signed)) if len(b) >= size else ""


def _real(size: int, code: str) -> Callable[[bytes], str]:
    return lambda b: "%f" % struct.unpack(code, b[:size])[0] if len(b) >= size else ""


def _hex(size: int) -> Callable[[bytes], str]:
    return lambda b: f"0x{int.from_bytes(b[:size], 'little'):x}" if len(b) >= size else ""


def _guid(b: bytes) -> str:
    if len(b) < 16:
        return ""
    a, x, y = struct.unpack_from("<IHH", b)
    return f"{a:08X}-{x:04X}-{y:04X}-{b[8:10].hex().upper()}-{b[10:16].hex().upper()}"


def _sid(b: bytes) -> str:
    if len(b) < 8:
        return ""
    n = min(b[1], (len(b) - 8) // 4)
    return "-".join(["S", str(b[0]), str(int.from_bytes(b[2:8], "big")), *map(str, struct.unpack_from(f"<{n}I", b, 8))])


def _system_time(b: bytes) -> str:
    if len(b) < 16:
        return ""
    year, month, _, day, hour, minute, second, _ = struct.unpack_from("<8H", b)
    return f"{year:04d}-{month:02d}-{day:02d}T{hour:02d}:{minute:02d}:{second:02d}"


def _flag(b: bytes) -> str:
    return "" if not b else "true" if int.from_bytes(b[:4] if len(b) >= 4 else b[:1], "little") else "false"


#: Value types and their text.
VALUES: dict[int, Callable[[bytes], str]] = {
    0x00: lambda b: "",
    0x01: lambda b: utf16le_text(b[: 2 * min(len(b) // 2, MOST_CHARS)]),
    0x02: lambda b: b.rstrip(b"\0").decode("utf-8", "replace"),
    0x03: _integer(1, True), 0x04: _integer(1, False), 0x05: _integer(2, True), 0x06: _integer(2, False),
    0x07: _integer(4, True), 0x08: _integer(4, False), 0x09: _integer(8, True), 0x0A: _integer(8, False),
    0x0B: _real(4, "<f"), 0x0C: _real(8, "<d"), 0x0D: _flag, 0x0F: _guid, 0x10: _integer(8, False), 0x11: _integer(8, False),
    0x12: _system_time, 0x13: _sid, 0x14: _hex(4), 0x15: _hex(8),
}


def value_text(kind: int, raw: bytes) -> str:
    """The text of a substitution value; kinds without a rule are dumped in hex."""
    rule = VALUES.get(kind & 0x7F)
    return rule(raw) if rule else raw[:MOST_CHARS].hex()


class Xml:
    """The flat list of (dotted path, text) of one record's binary XML."""

    def __init__(self, chunk: bytes):
        self.chunk = chunk
        self.fields: list[tuple[str, str]] = []
        self.warnings: list[str] = []
        self.root = ""
        self.path: list[str] = []
        self.open_templates: set[int] = set()
        self.templates = self.tokens = 0
        self.full = False

    def put(self, name: str, text: str) -> None:
        if self.full:
            return
        if len(self.fields) >= MOST_FIELDS:
            self.full = True
            self.warnings.append("max_fields reached; truncating")
        else:
            self.fields.append((name or "value", text))

    def name(self, c: Cursor) -> str:
        """A name where the cursor is, or where an offset into the chunk points."""
        here = c.at
        offset = c.number(4)
        if offset != here and offset < len(self.chunk):
            try:
                return self._name(Cursor(self.chunk, offset, len(self.chunk)))
            except Short:
                return ""
        c.at = here
        return self._name(c)

    @staticmethod
    def _name(c: Cursor) -> str:
        c.take(6)  # next offset and hash
        text = c.text()
        c.at += min(2, c.left())
        return text

    def substitutions(self, c: Cursor) -> list[str]:
        out: list[str] = []
        try:
            n = min(c.number(4), c.left() // 4, MOST_FIELDS)
            heads = [(c.number(2), c.number(1), c.take(1)) for _ in range(n)]
        except Short:
            return out
        for size, kind, _ in heads:
            out.append(value_text(kind, c.take(min(size, c.left()))))
        return out

    def template(self, c: Cursor, depth: int) -> None:
        c.take(5)
        at = c.number(4)
        self.templates += 1
        if self.templates > MOST_TEMPLATES:
            self.warnings.append("max_template_instances reached")
        elif depth >= MOST_DEPTH:
            self.warnings.append("max_depth reached in template")
        elif at >= len(self.chunk) or at in self.open_templates or at + 24 > len(self.chunk):
            reason = "template offset out of range" if at >= len(self.chunk) else "cyclic template definition" if at in self.open_templates else "truncated template definition"
            self.warnings.append(reason)
            self.substitutions(c)
        else:
            body, size = at + 24, int.from_bytes(self.chunk[at + 20 : at + 24], "little")
            values = self.substitutions(c)
            self.open_templates.add(at)
            self.walk(Cursor(self.chunk, body, body + size), values, depth + 1)
            self.open_templates.discard(at)

    def attribute(self, c: Cursor, values: list[str]) -> None:
        name = ".".join(self.path) + "@" + self.name(c)
        if not c.left():
            raise Short
        kind, text = c.data[c.at] & 0x3F, ""
        if kind == 0x05:
            c.take(1)
            text = c.text() if c.number(1) & 0x7F == 0x01 else ""
        elif kind in (0x0D, 0x0E):
            c.take(1)
            text = self.substituted(c, values)
        self.put(name, text)

    @staticmethod
    def substituted(c: Cursor, values: list[str]) -> str:
        k = c.number(2)
        c.take(1)
        return values[k] if k < len(values) else ""

    def walk(self, c: Cursor, values: list[str], depth: int = 0) -> None:
        """Tokens up to the end, an unknown one, or a limit; elements left open here are closed."""
        if depth >= MOST_DEPTH:
            self.warnings.append("max_depth reached in fragment")
            return
        opened = len(self.path)
        try:
            while c.left() > 0 and not self.full:
                self.tokens += 1
                if self.tokens > MOST_TOKENS:
                    self.warnings.append("token cap reached")
                    break
                token = c.number(1) & 0x3F
                here = ".".join(self.path)
                if token == 0x00:
                    break
                if token == 0x01:
                    c.take(6)
                    name = self.name(c)
                    if len(self.path) < MOST_DEPTH:
                        self.path.append(name)
                        self.root = self.root or name
                    else:
                        self.warnings.append("max_depth reached opening element")
                elif token in (0x03, 0x04):
                    if len(self.path) > opened:
                        self.path.pop()
                elif token == 0x05:
                    self.put(here, c.text() if c.number(1) & 0x7F == 0x01 else "")
                elif token == 0x06:
                    self.attribute(c, values)
                elif token == 0x07:
                    self.put(here, c.text())
                elif token == 0x08:
                    c.take(2)
                elif token in (0x09, 0x0A):
                    self.name(c)
                elif token == 0x0B:
                    c.take(2 * min(c.number(2), c.left() // 2))
                elif token == 0x0C:
                    self.template(c, depth)
                elif token in (0x0D, 0x0E):
                    self.put(here, self.substituted(c, values))
                elif token == 0x0F:
                    c.take(3)
                elif token != 0x02:
                    self.warnings.append("unknown BinXML token")
                    break
        except Short:
            pass
        del self.path[opened:]


def records(chunk: bytes) -> tuple[list[tuple[int, int, Xml]], list[str]]:
    """(record id, ticks, XML) of the records of a chunk, and what stopped it early."""
    free = min(max(int.from_bytes(chunk[FREE_OFFSET : FREE_OFFSET + 4], "little"), CHUNK_HEADER), len(chunk), CHUNK)
    at, found = CHUNK_HEADER, []
    while at + RECORD_HEADER <= free:
        mark, size, number, ticks = struct.unpack_from("<IIQQ", chunk, at)
        if mark & 0xFFFF != RECORD_MARK:
            break
        if size < RECORD_LEAST or size > free - at:
            return found, ["zero-length record; stopping" if size == 0 else "record size smaller than framing" if size < RECORD_LEAST else "record size exceeds remaining chunk"]
        xml = Xml(chunk)
        xml.walk(Cursor(chunk, at + RECORD_HEADER, at + size - 4), [])
        found.append((number, ticks, xml))
        at += size
    return found, []


def _leaf(fields: list[tuple[str, str]], *ends: str) -> str | None:
    """The first value under a name that ends so, whatever the case; further ends are tried while it is empty."""
    got = None
    for end in ends:
        value = next((v for n, v in fields if n.lower().endswith(end.lower())), None)
        got = value if value is not None else got
        if value:
            return value
    return got


def _data(fields: list[tuple[str, str]]) -> list[str]:
    """The first two values of event data."""
    headers = ("eventid", "level", "channel", "computer")
    return [v for n, v in fields if v and "Data" in n and not n.lower().endswith(headers)][:2]


_OUT = "file string, chunk bigint, nth bigint, number decimal(20,0), ts_us bigint, event_id string, level string, computer string, channel string, provider string, time_text string, data array<string>, fields array<struct<key:string,text:string>>, warnings array<string>"


def _decoded(batches):
    pairs = pa.list_(pa.struct([("key", pa.string()), ("text", pa.string())]))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.decimal128(20, 0), pa.int64(), *[pa.string()] * 6, pa.list_(pa.string()), pairs, pa.list_(pa.string())]
    names = ["file", "chunk", "nth", "number", "ts_us", "event_id", "level", "computer", "channel", "provider", "time_text", "data", "fields", "warnings"]
    for batch in batches:
        for file, k, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found, stopped = records(chunk)
            rows = []
            for nth, (number, ticks, xml) in enumerate(found):
                f = xml.fields
                last = stopped if nth == len(found) - 1 else []
                rows.append((file, k, nth, number, ticks // 10 - 11_644_473_600_000_000, _leaf(f, "EventID"), _leaf(f, "Level"), _leaf(f, "Computer"), _leaf(f, "Channel"), _leaf(f, "Provider@Name", "@Name", "Name"), _leaf(f, "TimeCreated@SystemTime", "@SystemTime"), _data(f), [{"key": n, "text": v} for n, v in f], xml.warnings + last))
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=False) for c, t in zip(cols, kinds, strict=True)], names)


def chunks(files: DataFrame) -> DataFrame:
    """(file, chunk, data) of files (file, content): 64 KiB pieces up to the first that is none, for files with the right magic."""
    size = F.octet_length("content")
    last = F.least(F.floor((size - FILE_HEADER - 1) / CHUNK), F.lit(MOST_CHUNKS - 1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(F.col("content"), k * CHUNK + FILE_HEADER + 1, F.lit(CHUNK)))
    good = F.transform("pieces", lambda p: (F.substring(p, 1, 8) == F.lit(CHUNK_MAGIC)) & (F.octet_length(p) >= CHUNK_HEADER))
    rows = files.where((F.substring("content", 1, 8) == F.lit(FILE_MAGIC)) & (size > FILE_HEADER)).select("file", cut.alias("pieces"))
    first_bad = F.array_position(good, F.lit(False))
    kept = F.when(first_bad > 0, F.slice("pieces", F.lit(1), (first_bad - 1).cast("int"))).otherwise(F.col("pieces"))
    return rows.select("file", F.posexplode(kept)).select("file", F.col("pos").cast("bigint").alias("chunk"), F.col("col").alias("data"))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content")


def to_events(files: DataFrame) -> DataFrame:
    """Records of files (file, content) as events; a record without a number has its place in the file."""
    from emberlog.functions.text import sanitize, truncate

    rows = chunks(files).mapInArrow(_decoded, _OUT)
    place = F.row_number().over(Window.partitionBy("file").orderBy("chunk", "nth"))
    rows = rows.withColumn("place", place.cast("bigint")).where(F.col("place") <= MOST_RECORDS).withColumn("line_no", F.col("place"))
    number = parse_u64(trim(F.col("event_id")))
    event_id = F.coalesce((number % (1 << 32)).cast("bigint"), F.lit(0))
    level = trim(F.col("level"))
    severity = F.when(parse_u64(level).isNotNull(), schema.from_windows((parse_u64(level) % (1 << 32)).cast("bigint"))).otherwise(schema.from_word(F.col("level")))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    data = F.transform("data", lambda v: truncate(sanitize(v), 48))
    message = F.concat_ws(" ", F.nullif(F.concat_ws("/", some("provider"), some("channel")), F.lit("")), F.when(event_id != 0, F.concat(F.lit("EventID="), event_id.cast("string"))), F.when(F.size("data") > 0, F.array_join(data, " ")))
    values = {
        "ts_us": F.coalesce(times.iso8601(trim(F.col("time_text"))), F.col("ts_us")),
        "severity": F.when(F.col("level").isNotNull(), severity),
        "source": F.lit("win-event"),
        # Numbers of 2^63 and more, which only damaged records have, keep their 64 bits.
        "record_index": F.when(F.col("number") >= F.lit(str(1 << 63)).cast("decimal(20,0)"), F.col("number") - F.lit(str(1 << 64)).cast("decimal(20,0)")).when(F.col("number") != 0, F.col("number")).otherwise(F.col("place")).cast("bigint"),
        "event_id": event_id,
        "host": F.col("computer"),
        "channel": F.col("channel"),
        "provider": F.col("provider"),
        "app": F.col("provider"),
        "message": message,
        "fields": string_fields(F.col("fields")),
    }
    problem = F.when(F.size("warnings") > 0, diagnostic("warn", "winlog.binxml", F.array_join("warnings", "; "), F.col("line_no"))).otherwise(F.lit(None).cast(DIAGNOSTIC))
    return events(rows, values, problem)



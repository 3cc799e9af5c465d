"""Small event log files made from rows, for queries and tests: no sample files come with this repository."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.sources.evtx import CHUNK, CHUNK_HEADER, CHUNK_MAGIC, FILE_HEADER, FILE_MAGIC, RECORD_MARK

EPOCH_TICKS = 116_444_736_000_000_000


def wide(text: str) -> bytes:
    raw = text.encode("utf-16-le")
    return struct.pack("<H", len(raw) // 2) + raw


class Body:
    """Binary XML at a place in a chunk; names are written where they are used."""

    def __init__(self, base: int):
        self.base, self.out = base, b"\x0f\x01\x01\x00"

    def name(self, text: str) -> None:
        at = self.base + len(self.out)
        raw = text.encode("utf-16-le")
        # The first four bytes are at once the offset of the name, which is here, and its hint.
        self.out += struct.pack("<IHH", at, 0, len(raw) // 2) + raw + b"\0\0"

    def element(self, name: str, text: str | None = None, attributes: dict[str, str] | None = None) -> Body:
        self.out += b"\x01" + b"\0" * 6
        self.name(name)
        for key, value in (attributes or {}).items():
            self.out += b"\x06"
            self.name(key)
            self.out += b"\x05\x01" + wide(value)
        self.out += b"\x02"
        if text is not None:
            self.out += b"\x05\x01" + wide(text) + b"\x04"
        return self

    def close(self) -> Body:
        self.out += b"\x04"
        return self


def record(at: int, number: int, ticks: int, fields: dict[str, str]) -> bytes:
    """A record for a place in its chunk: System members, and Data of EventData."""
    body = Body(at + 24)
    body.element("Event").element("System")
    for name in ("EventID", "Level", "Channel", "Computer"):
        if name in fields:
            body.element(name, fields[name])
    body.close().element("EventData").element("Data", fields.get("Data", "")).close().close()
    raw = body.out + b"\0"
    size = 24 + len(raw) + 4
    return struct.pack("<IIQQ", RECORD_MARK, size, number, ticks) + raw + struct.pack("<I", size)


def file(records: list[tuple[int, int, dict[str, str]]]) -> bytes:
    """An event log file of one chunk."""
    chunk = b""
    for number, ticks, fields in records:
        chunk += record(CHUNK_HEADER + len(chunk), number, ticks, fields)
    free = CHUNK_HEADER + len(chunk)
    head = (CHUNK_MAGIC + b"\0" * 40 + struct.pack("<I", free)).ljust(CHUNK_HEADER, b"\0")
    return FILE_MAGIC.ljust(FILE_HEADER, b"\0") + (head + chunk).ljust(CHUNK, b"\0")


def _files(rows: pd.Series) -> pd.Series:
    one = lambda r: (int(r["n"]), EPOCH_TICKS, {"EventID": str(1000 + r["n"]), "Level": "2", "Channel": "Sec", "Computer": r["n_name"], "Data": r["n_name"]})
    return rows.map(lambda group: file([one(r) for r in group]))


def file_column(rows: Column) -> Column:
    return F.pandas_udf(_files, "binary")(rows)

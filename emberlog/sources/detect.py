"""Formats by name and by content."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Names of formats; the first of each row is the canonical one.
NAMES = {
    "auto": "auto", "syslog": "syslog", "sys": "syslog", "json": "json", "jsonl": "json", "ndjson": "json", "web": "web", "web-access": "web", "access": "web",
    "clf": "web", "httpd": "web", "evtx": "evtx", "winevtx": "evtx", "win": "evtx", "winlog": "evtx", "cef": "cef",
}
HEAD = 1 << 16
#: Files whose beginnings are read at once, and judged together.
READERS, TOGETHER = 16, 256


def parse_name(name: str) -> str | None:
    """The format that a name means, None if none."""
    return NAMES.get(name.strip(" \t\r\n\v\f").lower())


def detect_format(content: Column) -> Column:
    """The format of binary content by its beginning: syslog unless something else fits."""
    text = F.decode(content, "ISO-8859-1")
    line = lambda n: F.regexp_extract(F.substring(text, 1, n), "^[^\\n]*", 0)
    return (
        F.when(F.octet_length(content) == 0, "syslog")
        .when(text.startswith("ElfFile"), "evtx")
        .when(line(256).contains("CEF:"), "cef")
        .when(text.rlike(r"^[ \t\r\n]*+[{\[]"), "json")
        .when(text.rlike(r"^[ \t\r\n]*+<[0-9]{1,3}>"), "syslog")
        .when(line(512).contains("[") & line(512).contains('"'), "web")
        .otherwise("syslog")
    )


def files(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files behind paths, folders and patterns; what names nothing is an error, and so is a hidden file that is named, as Spark's readers pass over it.

    Hidden files (a name that begins with a dot or an underscore) within folders and patterns are left out.
    """
    jvm, found = spark._jvm, []
    for path in [paths] if isinstance(paths, str) else paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        store = p.getFileSystem(spark._jsc.hadoopConfiguration())
        matches = list(store.globStatus(p) or [])
        if not matches:
            raise FileNotFoundError(f"cannot read: {path}")
        named = len(matches) == 1 and matches[0].isFile()
        if named and matches[0].getPath().getName()[0] in "._":
            raise PermissionError(f"cannot read a hidden file: {path}")
        for status in matches:
            inside = store.listStatus(status.getPath()) if status.isDirectory() else [status]
            found += [s.getPath().toString() for s in inside if s.isFile() and s.getPath().getName()[0] not in "._"]
    return sorted(found)


def head(spark: SparkSession, path: str, n: int = HEAD) -> bytes:
    """The first bytes of a file, through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def detect(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Path to format. Beginnings are read side by side and judged in groups, so the driver holds those of TOGETHER files at most."""
    found: dict[str, str] = {}
    with ThreadPoolExecutor(READERS) as pool:
        for k in range(0, len(paths), TOGETHER):
            some = paths[k : k + TOGETHER]
            table = spark.createDataFrame(list(zip(some, pool.map(lambda p: head(spark, p), some), strict=True)), "path string, content binary")
            found |= {r.path: r.format for r in table.select("path", detect_format(F.col("content")).alias("format")).collect()}
    return found

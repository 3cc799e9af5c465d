"""Parsers on hand-derived lines, on random bytes, and on artifacts in files."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog import cli
from emberlog.functions import times
from emberlog.plans import evtx_fixture
from emberlog.sources import cef, evtx, jsonl, syslog, weblog
from emberlog.sources.detect import detect_format, parse_name
from emberlog.sources.ingest import IngestOptions, ingest
from emberlog.sources.lines import from_texts, read_lines


def lined(spark, *lines):
    return spark.createDataFrame([("f", 0, k + 1, x) for k, x in enumerate(lines)], "file string, block bigint, line_no bigint, line string")


def parsed(spark, to_events, *lines):
    return to_events(lined(spark, *lines)).orderBy("line_no").collect()


def fields(row):
    return {f.key: f.text for f in row.fields}


def test_syslog_bsd(spark):
    a, b, c, d = parsed(spark, syslog.to_events, "<34>Oct 11 22:14:15 mymachine su[123]: 'su root' failed", "host app no colon", "", "<192>Oct 11 x")
    assert (a.severity, a.host, a.app, a.provider, a.pid, a.message) == (2, "mymachine", "su", "su", 123, "'su root' failed")
    assert (b.severity, b.host, b.app, b.message, b.ts_us) == (8, "host", "app", "no colon", None)
    assert (c.record_index, c.message, c.source) == (3, "", "syslog")
    assert (d.host, d.app) == ("<192>Oct", "11")


def test_syslog_structured_data(spark):
    line = '<165>1 2024-03-09T22:14:15.003Z h app - ID47 [a@1 x="1" y="q\\"\\\\\\]\\n"][b z="2" x=""] text'
    (a,) = parsed(spark, syslog.to_events, line)
    assert fields(a) == {"a@1.x": "1", "a@1.y": 'q"\\]\\n', "b.z": "2", "b.x": ""}
    assert (a.message, a.pid, a.severity) == ("text", -1, 5)
    bad, nil, many = parsed(spark, syslog.to_events, "<1>1 - - - - - [open x= rest", "<1>1 - h - - - - said", "<1>1 - h a - - " + "[x]" * 257 + " m")
    assert bad.message == "[open x= rest" and not bad.fields
    assert nil.message == "said" and nil.host == "h"
    assert many.severity == 8 and many.host == "" and many.message.startswith("<1>1") and many.diag.where == "syslog.line"


def test_syslog_tags(spark):
    rows = syslog.parse(lined(spark, "h sshd: m", "h kernel m", "h a[1][2]: m", "h [x]: m", "h a[: m")).orderBy("line_no").collect()
    assert [(r.app_name, r.proc_id, r.message) for r in rows] == [("sshd", "", "m"), ("kernel", "", "m"), ("a[1]", "2", "m"), ("", "x", "m"), ("a[", "", "m")]


def test_access_log(spark):
    a, b, c = parsed(spark, weblog.to_events, '1.2.3.4 - bob [10/Oct/2000:13:55:36 -0700] "GET /a?b HTTP/1.0" 404 12 "http://r" "x \\"y\\" z"', "   ", '1.1.1.1 - - [bad] "GET" - -') + [None]
    assert (a.user, a.http_method, a.http_path, a.http_status, a.bytes, a.severity, a.host) == ("bob", "GET", "/a?b", 404, 12, 4, "")
    assert a.message == "GET /a?b -> 404" and fields(a) == {"referer": "http://r", "user_agent": 'x "y" z'}
    assert b.record_index == 3 and b.message == "GET - -> 0" and b.diag.level == "debug" and c is None
    (d,) = parsed(spark, weblog.to_events, "one two")
    assert d.message == "unparsed: one two" and d.severity == 8 and d.diag.level == "warn"


def tokens_model(line):
    """The tokenizer read character by character."""
    out, i, n = [], 0, len(line)
    while i < n:
        while i < n and line[i] in " \t\r\n\v\f":
            i += 1
        if i >= n:
            break
        field = ""
        if line[i] == '"':
            i += 1
            while i < n and line[i] != '"':
                if line[i] == "\\" and i + 1 < n:
                    i += 1
                field += line[i]
                i += 1
            i += 1
        elif line[i] == "[":
            i += 1
            while i < n and line[i] != "]":
                field += line[i]
                i += 1
            i += 1
        else:
            while i < n and line[i] not in " \t\r\n\v\f":
                field += line[i]
                i += 1
        out.append(field)
    return out


def test_tokens_against_model(spark):
    r = random.Random(5)
    lines = ["".join(r.choice('ab "\\[] \t') for _ in range(r.randrange(14))) for _ in range(1500)]
    rows = lined(spark, *lines).select("line", weblog.tokens(F.col("line")).alias("t")).collect()
    assert [x for x in rows if x.t != tokens_model(x.line)] == []


def test_request_lines(spark):
    texts = ["GET /x HTTP/1.1", "", "GET", "GET /x", "GET /a b c HTTP/1.0"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, s string").select("n", weblog.request_line(F.col("s")).alias("r")).orderBy("n").collect()
    assert [tuple(x.r) for x in rows] == [("GET", "/x", "HTTP/1.1", True), ("", "", "", False), ("GET", "", "", False), ("GET", "/x", "", False), ("GET", "/a b c", "HTTP/1.0", False)]


def test_json(spark):
    rows = parsed(
        spark, jsonl.to_events, '{"time":"2024-03-09T11:22:34Z","level":"3","msg":"auth","user":"root","ip":"1.2.3.4","outcome":"failure"}', "", '{"ts":1709983354,"level":"INFO","message":{"a":[]}}',
        "[1, 2.5, null]", '{"a":1} x', '{"a":{"b":[1,{"c":null}]},"d":{},"e":1.5,"a.b.0":true}', '{"ts":1.5}', "[" * 70 + "]" * 70,
    )
    a, b, c, d, e, f, g = rows
    assert (a.severity, a.user, a.src_ip, a.message, a.record_index) == (3, "root", "1.2.3.4", "auth", 1)
    assert (b.ts_us, b.severity, b.message, b.record_index, b.line_no) == (1709983354000000, 6, '{"a":[]}', 2, 3)
    assert c.message == "[1,2.5,null]" and not c.fields
    assert d.message == '{"a":1} x' and d.diag.where == "jsonlog.parse" and d.diag.line == 5
    assert [(x.key, x.kind, x.text) for x in e.fields] == [("a.b.0", "bool", "true"), ("a.b.1.c", "null", ""), ("d", "string", "{}"), ("e", "double", "1.5")]
    assert f.ts_us == 1_500_000
    assert g.diag.detail.startswith("limit-exceeded")


def test_json_values():
    assert jsonl.parse('{"k":1,"z":2,"k":3}') == {"k": 3, "z": 2} and list(jsonl.parse('{"k":1,"z":2,"k":3}')) == ["k", "z"]
    assert jsonl.parse('"\\ud83d\\ude00 \\ud800"') == "😀 �"
    assert jsonl.depth([]) == 1 and jsonl.depth({"a": [1]}) == 3 and jsonl.compact({"a": [1, "é\n", 0.1]}) == '{"a":[1,"é\\n",0.10000000000000001]}'
    for bad in ("01", "NaN", '{"a":1,}', '"\n"', "", "{", '{"a" 1}'):
        with pytest.raises(ValueError):
            jsonl.parse(bad)
    assert isinstance(jsonl.parse("9223372036854775808"), float) and jsonl.parse("-9223372036854775808") == -(1 << 63)


def test_json_numbers_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(jsonl, "CHUNK", 7)
    texts = ["" if k % 5 == 0 else '{"msg":"%d"}' % k for k in range(60)]
    rows = [(f, b, n + 1, t) for f, b, n, t in [("f", n // 30 * 30, n, t) for n, t in enumerate(texts)] + [("g", 0, n, t) for n, t in enumerate(texts[:20])]]
    found = jsonl.to_events(spark.createDataFrame(rows, "file string, block bigint, line_no bigint, line string"))
    want = [(f, k + 1, x) for f, n in (("f", 60), ("g", 20)) for k, x in enumerate(t for t in range(n) if t % 5)]
    assert sorted((r.file, r.record_index, int(r.message)) for r in found.collect()) == want


def test_plain_times(spark):
    """Whole ISO times are read in the Python pass, and as by the columns."""
    assert jsonl.time_of("2024-03-09T11:22:34.5Z") == (1709983354500000, None) and jsonl.time_of(" 2024-03-09") == (None, " 2024-03-09")
    r = random.Random(10)
    two = lambda most: f"{r.randrange(most):02d}"
    tails = ["", "Z", ".1Z", ".123456", ".1234567+01:30", "-0230", "+9999", ".", "z", " Z", "+1", ".5-00:00", "Zx"]
    texts = [f"{r.choice(['2024', '1969', '0001', '0000', '9999', '1900'])}-{two(14)}-{two(33)}{r.choice('Tt ')}{two(25)}:{two(61)}:{two(62)}{r.choice(tails)}" for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", times.any_time(F.col("s")).alias("us")).collect()
    mine = [(x.s, jsonl.plain_time(x.s), x.us) for x in rows]
    assert [m for m in mine if m[1] is not None and m[1] != m[2]] == [] and sum(m[1] is not None for m in mine) > 100


def test_cef(spark):
    line = "<1>h CEF:0|Ven\\|dor|Pro\\\\d|1.0|100|name\\x|10|src=1.2.3.4 msg=a \\= b\\nc d dst=5.6.7.8 spt=80 spt=81 rt=1709983354000 junk suser=bob"
    a, b, c = parsed(spark, cef.to_events, line, "CEF:x|a", "CEF:0|a|b|c")
    assert (a.provider, a.app, a.event_id, a.severity, a.source) == ("Ven|dor Pro\\d", "Pro\\d", 100, 2, "unknown")
    assert (a.message, a.src_ip, a.dst_ip, a.src_port, a.user) == ("a = b\nc d", "1.2.3.4", "5.6.7.8", 80, "bob")
    assert a.ts_us is None and fields(a)["rt"] == "1709983354000 junk" and fields(a)["cef.version"] == "0" and fields(a)["cef.name"] == "name\\x"
    assert b.diag.detail.startswith("cef: missing field separator") and c.diag.detail.startswith("cef: fewer")
    (d,) = parsed(spark, cef.to_events, "CEF:0|v|p|1|sig|n|High|rt=1709983354000 word =x k=v")
    assert d.ts_us == 1709983354000000 or d.ts_us is None
    assert d.severity == 3 and d.event_id == 0 and fields(d)["k"] == "v"


def test_event_log(spark):
    raw = evtx_fixture.file([(7, evtx_fixture.EPOCH_TICKS + 10, {"EventID": "4625", "Level": "2", "Channel": "Security", "Computer": "pc", "Data": "bob"}), (0, evtx_fixture.EPOCH_TICKS, {"EventID": "1", "Level": "error"})])
    rows = evtx.to_events(spark.createDataFrame([("f", raw), ("g", b"ElfFile\0" + b"\0" * 5000), ("h", b"no")], "file string, content binary")).orderBy("line_no").collect()
    a, b = rows
    assert (a.record_index, a.ts_us, a.event_id, a.severity, a.channel, a.host, a.source) == (7, 1, 4625, 3, "Security", "pc", "win-event")
    assert a.message == "Security EventID=4625 bob" and fields(a)["Event.System.EventID"] == "4625"
    assert (b.record_index, b.severity) == (2, 3)


def test_event_log_values():
    assert evtx.value_text(0x81 & 0x7F, "é".encode("utf-16-le")) == "é" and evtx.value_text(0x03, b"\xff") == "-1" and evtx.value_text(0x14, b"\x10\0\0\0") == "0x10"
    assert evtx.value_text(0x13, bytes([1, 2, 0, 0, 0, 0, 0, 5, 32, 0, 0, 0, 33, 0, 0, 0])) == "S-1-5-32-33"
    assert evtx.value_text(0x0F, bytes(range(16))) == "03020100-0504-0706-0809-0A0B0C0D0E0F" and evtx.value_text(0x0E, b"\x01\xff") == "01ff"
    assert evtx.value_text(0x12, b"\xe8\x07\x03\0\0\0\x09\0\x0b\0\x16\0\x21\0\0\0") == "2024-03-09T11:22:33" and evtx.value_text(0x0D, b"\0\0\0\0") == "false"


def test_nothing_breaks_parsers(spark):
    r = random.Random(9)
    noise = ["".join(chr(r.choice([r.randrange(1, 128), r.randrange(1, 0x500)])) for _ in range(r.randrange(40))).replace("\n", " ") for _ in range(150)]
    for to_events in (syslog.to_events, weblog.to_events, jsonl.to_events, cef.to_events):
        assert len(parsed(spark, to_events, *noise)) <= len(noise)
    for _ in range(200):
        chunk = bytearray(evtx_fixture.file([(1, 5, {"EventID": "1", "Data": "x" * 50})])[4096:])
        for _ in range(8):
            chunk[r.randrange(512, 900)] = r.randrange(256)
        evtx.records(bytes(chunk))


def test_event_log_numbers(spark):
    """A record number beyond 63 bits breaks nothing and keeps its bits."""
    raw = evtx_fixture.file([(2**64 - 2, 0, {"EventID": "1"}), (2**63 - 1, 0, {"EventID": "2"})])
    assert [r.record_index for r in evtx.to_events(spark.createDataFrame([("f", raw)], "file string, content binary")).orderBy("line_no").collect()] == [-2, 2**63 - 1]


def test_artifacts_that_are_not_there(spark, tmp_path, capsys):
    (tmp_path / ".hidden.log").write_text("x\n")
    (tmp_path / "a.log").write_text("plain\n")
    for path, kind in ((tmp_path / "nope.log", FileNotFoundError), (tmp_path / ".hidden.log", PermissionError)):
        with pytest.raises(kind):
            ingest(spark, str(path))
        assert cli.main(["stats", str(path)], spark) == 1 and "cannot read" in capsys.readouterr().err
    assert ingest(spark, str(tmp_path))[0].count() == 1


def test_formats(spark):
    heads = {b"": "syslog", b"ElfFile\0": "evtx", b"<1>h CEF:0|": "cef", b" \n[1]": "json", b"<34>x": "syslog", b'h [t] "r"': "web", b"plain": "syslog", b'{"x":"CEF:"}': "cef", b"<1234>[a\"": "web"}
    rows = spark.createDataFrame([(bytearray(k),) for k in heads], "c binary").select("c", detect_format(F.col("c")).alias("f")).collect()
    assert {bytes(x.c): x.f for x in rows} == heads
    assert parse_name(" NDJSON ") == "json" and parse_name("x") is None


def test_ingest_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"<34>Oct 11 22:14:15 h su: one\r\n\r\nh t: two\rthree\n")
    (tmp_path / "b.jsonl").write_bytes(b'{"msg":"x"}\n\n{"msg":"y"}\n{bad\n')
    (tmp_path / "c.evtx").write_bytes(evtx_fixture.file([(3, 0, {"EventID": "9"})]))
    found, said = ingest(spark, str(tmp_path))
    rows = found.orderBy("pos").collect()
    assert [(r.pos, r.record_index, r.message) for r in rows] == [(0, 1, "one"), (1, 2, ""), (2, 3, "two\rthree"), (3, 1, "x"), (4, 2, "y"), (5, 3, "{bad"), (6, 3, "EventID=9")]
    assert sorted(d.detail for d in said.where("level = 'info'").collect()) == ["auto-detected format: evtx", "auto-detected format: json", "auto-detected format: syslog"]
    assert said.where("level = 'warn'").first().line == 4
    with pytest.raises(ValueError):
        ingest(spark, str(tmp_path), IngestOptions("nonsense"))


def test_lines_in_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = read_lines(spark, str(tmp_path / "big.log")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.block for r in rows}) > 2 and sorted((r.line_no, r.line) for r in rows) == [(k + 1, f"line {k}") for k in range(5000)]
    assert from_texts(spark.createDataFrame([("f", "a\n\nb")], "file string, text string")).count() == 3

"""Filters, windows, detectors, sessions, reports and sinks against plain Python models."""

import json
import random

import pytest
from pyspark.sql import functions as F

from emberlog import cli, schema
from emberlog.operators import detect, query, report, sessions, sinks, stats, timeline
from emberlog.operators.detect import DetectionConfig
from emberlog.operators.tables import numbered, sort_by_time
from emberlog.operators.windows import densest, densest_distinct, within

S = 1_000_000


def made(spark, rows):
    """Events from dicts; pos is the place in the list."""
    names = [n for n in schema.COLUMNS if n != "fields"]
    data = [(k, *(r.get(n) for n in names), [(a, "string", b) for a, b in r.get("fields", {}).items()]) for k, r in enumerate(rows)]
    kinds = ", ".join(["pos bigint"] + [f"v_{n} {'bigint' if schema.COLUMNS[n][0] in ('tinyint', 'decimal(20,0)') else schema.COLUMNS[n][0]}" for n in names] + [f"v_fields {schema.FIELDS}"])
    raw = spark.createDataFrame(data, kinds)
    return schema.event(raw, {n: F.col(f"v_{n}") for n in schema.COLUMNS}, ["pos"])


EVENTS = [
    {"severity": 3, "host": "Web1", "message": "Failed login", "http_status": 404, "fields": {"x": "10", "host": "shadow"}},
    {"severity": 8, "host": "", "message": "ok", "fields": {"host": "inner", "x": "9", "status": "7"}},
    {"severity": 6, "host": "db", "message": "", "fields": {"x": "abc"}},
]


@pytest.mark.parametrize(
    "text, want",
    [
        ("", {0, 1, 2}), ("host=web1", {0}), ("host=inner", {1}), ("host~IN", {1}), ("host!=db", {0, 1}), ("severity>=error", {0}), ("severity<=error", {0, 1, 2}), ("severity>6", {0}),
        ("severity=err", set()), ("status=404", {0}), ("status=0", {1, 2}), ("status=7", set()), ("x<10", {1}), ("x>=10", {0, 2}), ("x>abb", {2}), ('nothing=""', {0, 1, 2}), ("nothing<1", set()),
        ("host=db OR x=10 AND severity=error", {0}), ('message="failed login"', {0}), ("severity = informational and host ~ d", {2}), ("message!~ok", {0, 2}), ("status>abc", set()),
    ],
)
def test_filters(spark, text, want):
    assert {r.pos for r in query.where(made(spark, EVENTS), text).collect()} == want


@pytest.mark.parametrize("text", ["host", "host=", "=x", "host==", 'host="x', "a=b c=d", "a=b and", " AND a=b"])
def test_bad_filters(text):
    if text in ("host==",):
        assert query.parse(text).predicates[0].value == "="
        return
    with pytest.raises(query.FilterError):
        query.parse(text)


def test_filter_limits():
    assert len(query.parse(" AND ".join(["a=b"] * 256)).predicates) == 256
    with pytest.raises(query.FilterError):
        query.parse(" AND ".join(["a=b"] * 257))


def window_model(times, win):
    best = None
    left = 0
    for right, t in enumerate(times):
        while times[left] < t - win:
            left += 1
        if best is None or right - left + 1 > best[0]:
            best = (right - left + 1, times[left], t)
    return best


def test_densest_against_model(spark):
    r = random.Random(3)
    rows = [(f"k{r.randrange(6)}", r.randrange(400) * S // 2, k) for k in range(800)]
    got = {x.entity: (x["count"], x.first_us, x.last_us) for x in densest(spark.createDataFrame(rows, "entity string, ts_us bigint, pos bigint"), "entity", 7 * S).collect()}
    assert got == {e: window_model(sorted(t for k, t, _ in rows if k == e), 7 * S) for e in got} and len(got) == 6


def test_densest_on_long_windows_and_ties(spark):
    """Windows over many blocks, moments that repeat, times before 1970 and a window of no length."""
    r = random.Random(11)
    rows = [("hot" if r.random() < 0.6 else f"k{r.randrange(4)}", r.randrange(-4000, 9000) * S // r.choice((1, 3)), k) for k in range(1500)]
    rows += [("hot", 17 * S, 2000 + k) for k in range(5)] + [("one", -5, 3000)]
    table = spark.createDataFrame(rows, "entity string, ts_us bigint, pos bigint").cache()
    for win in (0, 5, S, 97 * S, 5000 * S):
        got = {x.entity: (x["count"], x.first_us, x.last_us) for x in densest(table, "entity", win).collect()}
        assert got == {e: window_model(sorted(t for k, t, _ in rows if k == e), win) for e in {k for k, _, _ in rows}}, win


def test_densest_has_no_sliding_frame(spark):
    """Spark sums a frame that slides anew for every row, which is events times those in a window."""
    table = spark.range(10).selectExpr("'e' entity", "id ts_us", "id pos")
    plan = densest(table, "entity", 100 * S)._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan


def test_within(spark):
    r = random.Random(12)
    rows = [(f"k{r.randrange(4)}", r.randrange(-500, 500), k) for k in range(300)]
    spans = [("k0", -100, -60), ("k1", -7, 33), ("k2", 499, 499)]
    found = spark.createDataFrame(spans, "entity string, first_us bigint, last_us bigint")
    table = spark.createDataFrame(rows, "entity string, ts_us bigint, pos bigint")
    for win in (40, 1000):
        assert sorted(map(tuple, within(table, found, "entity", win).collect())) == sorted(x for x in rows for e, a, b in spans if x[0] == e and a <= x[1] <= b)


def test_densest_distinct_against_model(spark):
    r = random.Random(4)
    rows = [(f"k{r.randrange(5)}", f"t{r.randrange(9)}", r.randrange(150) * S, k) for k in range(400)]
    found = densest_distinct(spark.createDataFrame(rows, "entity string, target string, ts_us bigint, pos bigint"), "entity", "target", 6 * S).collect()
    for x in found:
        own = sorted((t, p, g) for e, g, t, p in rows if e == x.entity)
        best, left = (0,), 0
        for right in range(len(own)):
            while own[left][0] < own[right][0] - 6 * S:
                left += 1
            n = len({g for _, _, g in own[left : right + 1]})
            if n > best[0]:
                best = (n, own[left][0], own[right][0], own[right][1])
        assert (x["count"], x.first_us, x.last_us, x.last_pos) == best
    assert len(found) == 5


def test_detectors(spark):
    rows = [{"ts_us": k * 10 * S, "host": "srv", "message": f"Failed password for u{k}", "source": "syslog", "severity": 6} for k in range(6)]
    rows += [{"ts_us": 70 * S, "host": "srv", "message": "Accepted password for root", "source": "syslog", "severity": 6}]
    rows += [{"ts_us": (100 + k) * S, "src_ip": "9.9.9.9", "http_path": f"/{k}", "http_status": 404, "http_method": "GET", "source": "web-access", "severity": 4} for k in range(30)]
    rows += [{"ts_us": (500 + k) * S, "severity": 2, "message": "down", "host": "z"} for k in range(10)]
    random.Random(1).shuffle(rows)
    found = detect.run(sort_by_time(made(spark, rows))).collect()
    assert [(f.kind, f.entity, f["count"]) for f in found] == [("auth-brute-force", "srv", 6), ("auth-spray-then-hit", "srv", 6), ("rare-signature", "syslog||Accepted password for root", 1), ("http-error-burst", "9.9.9.9", 30), ("port-or-path-scan", "9.9.9.9", 30), ("severity-spike", "(global)", 10)]
    assert found[0].evidence == [0, 1, 2, 3, 4, 5] and found[1].evidence == [0, 1, 2, 3, 4, 5, 6] and found[3].evidence == list(range(7, 37))
    off = DetectionConfig(bruteforce_min_failures=0, http_error_min=0, scan_distinct_min=0, severity_spike_min=0, rare_signature_max=0)
    assert detect.run(sort_by_time(made(spark, rows)), off).count() == 0


def test_spray_against_model(spark):
    """The first success at or after the N-th failure; an actor's failures don't meet again to find it."""
    r = random.Random(13)
    rows = [{"ts_us": r.randrange(3000) * S, "host": r.choice(["hot"] * 6 + ["a", "b", "c"]), "message": r.choice(["Failed password", "Accepted password", "tick"])} for _ in range(600)]
    cfg = DetectionConfig(bruteforce_min_failures=5, bruteforce_window_seconds=150, evidence_cap=8)
    want = {}
    for host in ("hot", "a", "b", "c"):
        mine = lambda text: sorted((e["ts_us"], k) for k, e in enumerate(rows) if e["host"] == host and e["message"].startswith(text))  # noqa: E731, B023
        fails, best = mine("Failed"), window_model([t for t, _ in mine("Failed")], 150 * S)
        hits = [x for x in mine("Accepted") if x[0] >= fails[4][0]]
        if best[0] >= 5 and hits:
            want[host] = (best[0], fails[0][0], hits[0][0], [k for _, k in fails[:7]] + [hits[0][1]])
    found = detect.spray_then_hit(made(spark, rows), cfg)
    assert {x.entity: (x["count"], x.first_us, x.last_us, x.evidence) for x in found.collect()} == want and "hot" in want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 5 and "RangeFrame, -" not in plan  # what marks an actor is there twice, by one shuffle each


def test_all_detectors_have_no_sliding_frame(spark):
    plan = detect.run(made(spark, EVENTS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") > 8 and "RangeFrame, -" not in plan


def test_sessions_and_timeline(spark):
    rows = [{"ts_us": t * S, "src_ip": ip, "severity": 3 if t == 0 else 6} for t, ip in ((0, "a"), (100, "a"), (201, "a"), (50, "b"))] + [{"src_ip": "a"}]
    found = sessions.sessions(made(spark, rows), "ip", 100).collect()
    assert [(r.key, r.start_us // S, r.events, r.duration_seconds, r.positions) for r in found] == [("a", 0, 2, 100, [0, 1]), ("b", 50, 1, 0, [3]), ("a", 201, 1, 0, [2])]
    line = timeline.buckets(made(spark, rows), 60).orderBy("bucket").collect()
    assert [(r.bucket, r["count"], r.error_or_worse) for r in line] == [(0, 2, 1), (1, 1, 0), (2, 0, 0), (3, 1, 0)]
    assert timeline.peak(timeline.buckets(made(spark, rows), 60)).first().bucket == 0
    assert [(g.before_us // S, g.after_us // S, g.seconds) for g in timeline.gaps(made(spark, rows), 50).collect()] == [(100, 201, 101)]
    assert timeline.gaps(made(spark, rows), 0).count() == 0 and timeline.buckets(made(spark, [{"host": "x"}]), 60).count() == 0


@pytest.mark.parametrize("idle", [0, 1, 40, 5000])
def test_sessions_against_model(spark, monkeypatch, idle):
    monkeypatch.setattr(sessions, "BLOCK", 3)  # so that sessions run over many blocks
    r = random.Random(idle)
    rows = [{"ts_us": r.randrange(-2000, 8000) * S // r.choice((1, 3)), "src_ip": "hot" if r.random() < 0.7 else r.choice("abc")} for _ in range(500)]
    rows += rows[:50] + [{"ts_us": 5 * S}, {"src_ip": "a"}, {"ts_us": 5 * S, "src_ip": ""}]
    want = []
    for key in ("hot", *"abc"):
        mine = sorted((e["ts_us"], k) for k, e in enumerate(rows) if e.get("src_ip") == key and "ts_us" in e)
        for t, k in mine:
            if not want or want[-1][0] != key or t - want[-1][2] > idle * S:
                want.append([key, t, t, []])
            want[-1][2] = t
            want[-1][3].append(k)
    want = sorted(([key, a, b, len(ks), ks] for key, a, b, ks in want), key=lambda x: (x[1], x[0]))
    table = made(spark, rows)
    found = sessions.sessions(table, "ip", idle).collect()
    assert [[x.key, x.start_us, x.end_us, x.events, x.positions] for x in found] == want
    plain = sessions.sessions(table, "ip", idle, positions=False)
    assert "positions" not in plain.columns and [[x.key, x.start_us, x.end_us, x.events] for x in plain.collect()] == [w[:4] for w in want]
    assert sessions.sessions(table.where("pos < 0"), "ip", idle).count() == 0


def test_gaps_against_model(spark):
    r = random.Random(8)
    times = sorted(r.randrange(10**6) * S // 7 for _ in range(600))
    got = [(g.before_us, g.after_us) for g in timeline.gaps(made(spark, [{"ts_us": t} for t in times]), 300).collect()]
    assert got == [(a, b) for a, b in zip(times, times[1:]) if b - a > 300 * S]


def test_numbered(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert all(r.pos == r.v for r in numbered(rows, [F.col("v")]).collect())
    assert numbered(rows.where("v < 0"), [F.col("v")]).count() == 0


def test_written_csv(spark, tmp_path):
    """Records stand in the files as their text: blanks at ends, quotes and control characters stay."""
    rows = schema.event(spark.createDataFrame([("tail space  ",), ('a "b"\nc',), ("x\x01y",)], "m string"), {"message": F.col("m")})
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    start = ",unknown,unknown,0" + "," * 16
    assert text == "\n".join([sinks.csv_header(), start + "tail space  ", start + '"a ""b""\nc"', start + "x\x01y"]) + "\n"


def test_sinks(spark):
    rows = made(spark, [{"ts_us": 1, "message": 'a"b\\c\n\x01é', "pid": 0, "bytes": 2**62, "fields": {"k": 'v"'}}, {"record_index": 5, "host": "x,y"}])
    texts = [r.value for r in sinks.ndjson(rows.orderBy("pos")).collect()]
    assert json.loads(texts[0]) == {"timestamp": "1970-01-01T00:00:00.000001Z", "severity": "unknown", "source": "unknown", "record_index": 0, "pid": 0, "bytes": 2**62, "message": 'a"b\\c\n\x01é', "fields": {"k": 'v"'}}
    assert "\\u0001" in texts[0] and texts[1] == '{"severity":"unknown","source":"unknown","record_index":5,"host":"x,y"}'
    lines = [r.value for r in sinks.csv(rows.orderBy("pos")).collect()]
    assert lines[1] == ',unknown,unknown,5,"x,y"' + "," * 15 and sinks.csv_header().count(",") == 19


def test_statistics(spark):
    rows = made(spark, EVENTS)
    assert {(r.dimension, r.key): r["count"] for r in stats.counters(rows, ["host", "severity"]).collect()} == {("host", "Web1"): 1, ("host", "db"): 1, ("severity", "error"): 1, ("severity", "unknown"): 1, ("severity", "informational"): 1}
    one = stats.scalars(rows).first()
    assert (one.total, one.timed, one.error_or_worse, one.span_seconds) == (3, 0, 1, 0)
    assert stats.at_least(rows, 3).first()["count"] == 1


def test_report_and_commands(spark, tmp_path, capsys):
    (tmp_path / "w.log").write_text("".join(f'9.9.9.9 - - [12/Dec/2023:08:30:{k:02d} +0000] "GET /{k} HTTP/1.1" 404 1\n' for k in range(30)))
    path = str(tmp_path / "w.log")
    assert cli.main(["detect", path, "--evidence"], spark) == 0
    out = capsys.readouterr().out
    assert "http-error-burst: 30 HTTP" in out and "(+14 more)" in out and "#29" in out
    assert cli.main(["stats", path], spark) == 0 and "4xx  30" in capsys.readouterr().out
    assert cli.main(["timeline", path, "--sessions", "ip"], spark) == 0 and "duration: 29s" in capsys.readouterr().out
    assert cli.main(["export", path, "-o", "csv", "--filter", "path=/3"], spark) == 0 and len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["parse", path, "--limit", "2", "--fields", "--diagnostics"], spark) == 0 and len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["export", path, "--filter", "x"], spark) == 2
    assert "Total findings: 0" in report.full(made(spark, []))


def test_stream(spark, tmp_path):
    from emberlog.streaming import tail

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("".join(f'1.1.1.{k % 2} - - [12/Dec/2023:08:{k:02d}:00 +0000] "GET / HTTP/1.1" 500 1\n' for k in range(10)))
    q = tail.counts(tail.tail(spark, str(folder), "web"), "5 minutes").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["count"], r.error_or_worse) for r in spark.table("counted").collect()) == [(5, 5), (5, 5)]

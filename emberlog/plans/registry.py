"""Registered queries over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.functions import text as T
from emberlog.functions import times
from emberlog.operators import detect, query, sessions, sinks, stats, tables, timeline
from emberlog.operators import events as E
from emberlog.operators.detect import DetectionConfig
from emberlog.plans.driver_views import events, logins, requests, table
from emberlog.plans import evtx_fixture
from emberlog.sources import cef, evtx, jsonl, syslog, weblog
from emberlog.sources import detect as formats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Thresholds that find something in the driver's events, which are sparse.
CFG = DetectionConfig(bruteforce_min_failures=6, bruteforce_window_seconds=3 * 86400, http_error_min=8, http_error_window_seconds=3 * 86400, scan_distinct_min=14, scan_window_seconds=3 * 86400, severity_spike_min=5, severity_spike_window_seconds=3600, rare_signature_max=3)
IDLE, BUCKET, GAP = 6 * 3600, 3600, 900

US = "epoch_us(ts)"
IP = "'10.0.' || (user_id // 256) || '.' || (user_id % 256)"
#: The canonical view of driver_views.events in SQL.
EV = f"""ev AS (SELECT event_id AS pos, {US} AS ts_us,
  CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 6 ELSE 7 END AS severity,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'notice' WHEN 'signup' THEN 'informational' ELSE 'debug' END AS severity_name,
  'h' || (user_id % 8) AS host, event_type AS app, 'u' || user_id AS "user", {IP} AS src_ip,
  event_type || ' value ' || CAST(trunc(value) AS BIGINT) AS message, json_extract_string(props, '$.k') AS k,
  'json|' || event_type || '|' || left(regexp_replace(event_type || ' value ' || CAST(trunc(value) AS BIGINT), '[0-9]+', '#', 'g'), 120) AS signature
  FROM events)"""
RQ = f"rq AS (SELECT event_id AS pos, {US} AS ts_us, {IP} AS entity, '/p/' || (event_id % 97) AS path, CASE event_type WHEN 'error' THEN 500 + event_id % 4 WHEN 'click' THEN 404 ELSE 200 END AS status FROM events)"
LG = f"lg AS (SELECT event_id AS pos, {US} AS ts_us, 'h' || (user_id % 8) AS entity, event_type AS kind FROM events)"
ISO = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S.%fZ')"


def registered(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# --- filters ---

FILTERS = {
    "eq": ("app=ERROR", "app = 'error'"),
    "ne": ("app!=click", "app <> 'click'"),
    "contains": ("message~VALUE", "contains(message, 'value')"),
    "not_contains": ("message!~error", "NOT contains(message, 'error')"),
    "severity": ("severity>=notice", "severity <= 5"),
    "numeric": ("status<1 AND event_id>=0", "true"),
    "fold_or_and": ("app=error OR app=click AND user=u1", "(app = 'error' OR app = 'click') AND \"user\" = 'u1'"),
    "dynamic_field": ("k>=50 AND k<60", "CAST(k AS BIGINT) >= 50 AND CAST(k AS BIGINT) < 60"),
    "fallthrough": ('host="h3" AND k!=7 AND status=0', "host = 'h3' AND k <> '7'"),
}


def _filter(name: str, text: str, sql: str) -> None:
    def run(spark, sf_dir):
        return query.where(events(spark, sf_dir), text).select("pos", "app", "message")

    registered(f"ev_filter_{name}", f"WITH {EV} SELECT pos, app, message FROM ev WHERE {sql}")(run)


for _name, (_text, _sql) in FILTERS.items():
    _filter(_name, _text, _sql)


@registered("ev_signature", f"WITH {EV} SELECT pos, signature FROM ev")
def ev_signature(spark, sf_dir):
    return events(spark, sf_dir).select("pos", E.signature().alias("signature"))


@registered("ev_summary", f"WITH {EV} SELECT pos, {ISO.format('ts_us')} || '  ' || severity_name || '  json  host=' || host || '  app=' || app || '  src=' || src_ip || '  ' || message AS summary FROM ev")
def ev_summary(spark, sf_dir):
    return events(spark, sf_dir).select("pos", E.summary().alias("summary"))


@registered("ev_actor", f"WITH {EV} SELECT pos, src_ip AS actor FROM ev")
def ev_actor(spark, sf_dir):
    return events(spark, sf_dir).select("pos", E.actor().alias("actor"))


@registered("ev_auth", f"WITH {LG} SELECT pos, kind = 'error' AS failed, kind = 'purchase' AS passed FROM lg")
def ev_auth(spark, sf_dir):
    return logins(spark, sf_dir).select("pos", E.is_failed_auth().alias("failed"), E.is_successful_auth().alias("passed"))


# --- statistics ---

_DIMENSIONS = {"source": "'json'", "severity": "severity_name", "host": "host", "app": "app", "user": '"user"', "src_ip": "src_ip", "signature": "signature"}


def _counter(dimension: str, sql: str) -> None:
    def run(spark, sf_dir):
        return stats.counters(events(spark, sf_dir), [dimension])

    registered(f"stats_{dimension}", f"WITH {EV} SELECT '{dimension}' AS dimension, {sql} AS key, count(*) AS count FROM ev GROUP BY ALL")(run)


for _name, _sql in _DIMENSIONS.items():
    _counter(_name, _sql)


@registered("stats_http_class", f"WITH {RQ} SELECT 'http_class' AS dimension, (status // 100) || 'xx' AS key, count(*) AS count FROM rq GROUP BY ALL")
def stats_http_class(spark, sf_dir):
    return stats.counters(requests(spark, sf_dir), ["http_class"])


@registered("stats_all", "WITH " + EV + " " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {k} AS key, count(*) AS count FROM ev GROUP BY ALL" for d, k in _DIMENSIONS.items()))
def stats_all(spark, sf_dir):
    return stats.counters(events(spark, sf_dir))


@registered("stats_scalars", f"WITH {EV} SELECT count(*) AS total, count(ts_us) AS timed, count(*) - count(ts_us) AS untimed, count(*) FILTER (severity <= 3) AS error_or_worse, min(ts_us) AS earliest, max(ts_us) AS latest, (max(ts_us) - min(ts_us)) // 1000000 AS span_seconds FROM ev")
def stats_scalars(spark, sf_dir):
    return stats.scalars(events(spark, sf_dir))


@registered("stats_topn", f'WITH {EV} SELECT \'user\' AS dimension, "user" AS key, count(*) AS count FROM ev GROUP BY ALL ORDER BY count DESC, key LIMIT 10')
def stats_topn(spark, sf_dir):
    return stats.top(stats.counters(events(spark, sf_dir), ["user"]), 10)


@registered("stats_totals", f"WITH {EV} SELECT 'host' AS dimension, count(DISTINCT host) AS \"distinct\", count(*) AS total FROM ev")
def stats_totals(spark, sf_dir):
    return stats.totals(stats.counters(events(spark, sf_dir), ["host"]))


@registered("stats_at_least", f"WITH {EV} SELECT count(*) FILTER (severity <= 5) AS count FROM ev")
def stats_at_least(spark, sf_dir):
    return stats.at_least(events(spark, sf_dir), 5)


# --- time line and sessions ---


@registered(
    "timeline_buckets",
    f"""WITH {EV}, lo AS (SELECT min(ts_us) AS low, max(ts_us) AS high FROM ev),
    line AS (SELECT unnest(range(0, (high - low) // {BUCKET * 1000000} + 1)) AS bucket, low FROM lo),
    c AS (SELECT (ts_us - low) // {BUCKET * 1000000} AS bucket, count(*) AS n, count(*) FILTER (severity <= 3) AS e FROM ev, lo GROUP BY ALL)
    SELECT line.bucket, low + line.bucket * {BUCKET * 1000000} AS start_us, coalesce(n, 0) AS count, coalesce(e, 0) AS error_or_worse FROM line LEFT JOIN c USING (bucket)""",
)
def timeline_buckets(spark, sf_dir):
    return timeline.buckets(events(spark, sf_dir), BUCKET)


@registered(
    "timeline_peak",
    f"""WITH {EV}, lo AS (SELECT min(ts_us) AS low FROM ev), c AS (SELECT (ts_us - low) // {BUCKET * 1000000} AS bucket, low, count(*) AS count FROM ev, lo GROUP BY ALL)
    SELECT bucket, low + bucket * {BUCKET * 1000000} AS start_us, count FROM c ORDER BY count DESC, bucket LIMIT 1""",
)
def timeline_peak(spark, sf_dir):
    return timeline.peak(timeline.buckets(events(spark, sf_dir), BUCKET))


@registered(
    "timeline_gaps",
    f"""WITH {EV}, g AS (SELECT lag(ts_us) OVER (ORDER BY ts_us) AS before_us, ts_us AS after_us FROM ev)
    SELECT before_us, after_us, (after_us - before_us) // 1000000 AS seconds FROM g WHERE after_us - before_us > {GAP * 1000000} ORDER BY after_us LIMIT 4096""",
)
def timeline_gaps(spark, sf_dir):
    return timeline.gaps(events(spark, sf_dir), GAP)


def _sessions(by: str, column: str) -> None:
    def run(spark, sf_dir):
        found = sessions.sessions(events(spark, sf_dir), by, IDLE)
        return found.select("key", "start_us", "end_us", "duration_seconds", "events", F.array_join("positions", ",").alias("positions"))

    sql = f"""WITH {EV}, a AS (SELECT {column} AS key, ts_us, pos, CASE WHEN ts_us - lag(ts_us) OVER w > {IDLE * 1000000} THEN 1 ELSE 0 END AS s FROM ev WINDOW w AS (PARTITION BY {column} ORDER BY ts_us, pos)),
    b AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY ts_us, pos ROWS UNBOUNDED PRECEDING) AS nth FROM a)
    SELECT key, min(ts_us) AS start_us, max(ts_us) AS end_us, (max(ts_us) - min(ts_us)) // 1000000 AS duration_seconds, count(*) AS events, string_agg(pos::VARCHAR, ',' ORDER BY ts_us, pos) AS positions FROM b GROUP BY key, nth"""
    registered(f"sessions_{by}", sql)(run)


for _name, _sql in {"ip": "src_ip", "user": '"user"', "host": "host"}.items():
    _sessions(_name, _sql)


# --- detectors ---


def _text(found: DataFrame) -> DataFrame:
    return found.select("kind", F.col("severity").cast("int").alias("severity"), "entity", "count", "first_us", "last_us", "title", F.array_join("evidence", ",").alias("evidence"))


def _window_sql(rows: str, kind: str, severity: int, least: int, seconds: int, title: str) -> str:
    """The densest window of each entity, by a range frame; rows: a CTE `o(entity, ts_us, pos)`."""
    win = seconds * 1000000
    return f"""WITH {rows}, w AS (SELECT entity, ts_us, count(*) OVER f AS n, min(ts_us) OVER f AS first_us FROM o WINDOW f AS (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN {win} PRECEDING AND CURRENT ROW)),
    b AS (SELECT entity, n AS count, first_us, ts_us AS last_us FROM w QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, ts_us) = 1),
    k AS (SELECT * FROM b WHERE count >= {least}),
    e AS (SELECT k.entity, o.pos, o.ts_us, row_number() OVER (PARTITION BY k.entity ORDER BY o.ts_us, o.pos) AS nth FROM k JOIN o ON o.entity = k.entity AND o.ts_us BETWEEN k.first_us AND k.last_us)
    SELECT '{kind}' AS kind, {severity} AS severity, k.entity, k.count, k.first_us, k.last_us, {title} AS title, string_agg(e.pos::VARCHAR, ',' ORDER BY e.nth) FILTER (e.nth <= 32) AS evidence FROM k JOIN e ON e.entity = k.entity GROUP BY ALL"""


_FAILS = f"{LG}, o AS (SELECT entity, ts_us, pos FROM lg WHERE kind = 'error')"
_SQL_BRUTE = _window_sql(_FAILS, "auth-brute-force", 1, CFG.bruteforce_min_failures, CFG.bruteforce_window_seconds, f"k.count || ' failed authentications from ' || k.entity || ' within {CFG.bruteforce_window_seconds}s'")
_SQL_HTTP = _window_sql(f"{RQ}, o AS (SELECT entity, ts_us, pos FROM rq WHERE status BETWEEN 400 AND 599)", "http-error-burst", 4, CFG.http_error_min, CFG.http_error_window_seconds, f"k.count || ' HTTP 4xx/5xx responses to ' || k.entity || ' within {CFG.http_error_window_seconds}s'")
_SQL_SPIKE = _window_sql(f"{EV}, o AS (SELECT '(global)' AS entity, ts_us, pos FROM ev WHERE severity <= 3)", "severity-spike", 3, CFG.severity_spike_min, CFG.severity_spike_window_seconds, f"k.count || ' error-or-worse events within {CFG.severity_spike_window_seconds}s'")
_SQL_SPRAY = f"""WITH {_FAILS}, w AS (SELECT entity, count(*) OVER (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN {CFG.bruteforce_window_seconds * 1000000} PRECEDING AND CURRENT ROW) AS n FROM o),
    k AS (SELECT entity, max(n) AS count FROM w GROUP BY entity HAVING max(n) >= {CFG.bruteforce_min_failures}),
    f AS (SELECT o.*, row_number() OVER (PARTITION BY entity ORDER BY ts_us, pos) AS nth FROM o JOIN k USING (entity)),
    m AS (SELECT entity, min(ts_us) AS first_us, max(ts_us) FILTER (nth = {CFG.bruteforce_min_failures}) AS from_us, string_agg(pos::VARCHAR, ',' ORDER BY nth) FILTER (nth <= 31) AS shown FROM f GROUP BY entity),
    h AS (SELECT m.entity, lg.ts_us, lg.pos FROM m JOIN lg ON lg.entity = m.entity AND lg.kind = 'purchase' AND lg.ts_us >= m.from_us QUALIFY row_number() OVER (PARTITION BY m.entity ORDER BY lg.ts_us, lg.pos) = 1)
    SELECT 'auth-spray-then-hit' AS kind, 2 AS severity, entity, count, first_us, h.ts_us AS last_us, 'successful authentication from ' || entity || ' after ' || count || ' failures' AS title, shown || ',' || h.pos AS evidence FROM k JOIN m USING (entity) JOIN h USING (entity)"""
_SQL_SCAN = f"""WITH {RQ}, w AS (SELECT entity, ts_us, pos, count(DISTINCT path) OVER f AS n, min(ts_us) OVER f AS first_us, count(*) OVER g AS again FROM rq
      WINDOW f AS (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN {CFG.scan_window_seconds * 1000000} PRECEDING AND CURRENT ROW),
      g AS (PARTITION BY entity, path ORDER BY ts_us RANGE BETWEEN {CFG.scan_window_seconds * 1000000} PRECEDING AND CURRENT ROW)),
    k AS (SELECT entity, n AS count, first_us, ts_us AS last_us, pos FROM w QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, ts_us, again, pos DESC) = 1),
    e AS (SELECT k.entity, o.pos, row_number() OVER (PARTITION BY k.entity ORDER BY o.ts_us, o.pos) AS nth FROM k JOIN rq o ON o.entity = k.entity AND o.ts_us BETWEEN k.first_us AND k.last_us WHERE k.count >= {CFG.scan_distinct_min})
    SELECT 'port-or-path-scan' AS kind, 4 AS severity, k.entity, k.count, k.first_us, k.last_us, k.entity || ' touched ' || k.count || ' distinct targets within {CFG.scan_window_seconds}s' AS title, string_agg(e.pos::VARCHAR, ',' ORDER BY e.nth) FILTER (e.nth <= 32) AS evidence FROM k JOIN e USING (entity) GROUP BY ALL"""
_SQL_RARE = f"""WITH {EV}, s AS (SELECT 'syslog|' || host || k || '|' || app AS entity, ts_us, pos FROM ev),
    c AS (SELECT entity, count(*) AS count, min(ts_us) AS first_us, max(ts_us) AS last_us, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS evidence FROM s GROUP BY entity HAVING count(*) <= {CFG.rare_signature_max})
    SELECT 'rare-signature' AS kind, 5 AS severity, entity, count, first_us, last_us, 'rare event signature seen ' || count || ' time(s): ' || entity AS title, evidence FROM c"""


@registered("det_bruteforce", _SQL_BRUTE)
def det_bruteforce(spark, sf_dir):
    return _text(detect.auth_bruteforce(logins(spark, sf_dir), CFG))


@registered("det_spray", _SQL_SPRAY)
def det_spray(spark, sf_dir):
    return _text(detect.spray_then_hit(logins(spark, sf_dir), CFG))


@registered("det_http_burst", _SQL_HTTP)
def det_http_burst(spark, sf_dir):
    return _text(detect.http_error_bursts(requests(spark, sf_dir), CFG))


@registered("det_scan", _SQL_SCAN)
def det_scan(spark, sf_dir):
    return _text(detect.scans(requests(spark, sf_dir), CFG))


@registered("det_spike", _SQL_SPIKE)
def det_spike(spark, sf_dir):
    return _text(detect.severity_spikes(events(spark, sf_dir), CFG))


def _rare_events(spark, sf_dir):
    """Events whose provider is host and number, so that some signatures are rare."""
    rows = events(spark, sf_dir)
    return rows.withColumns({"source": F.lit("syslog"), "provider": F.concat("host", F.col("fields")[0]["text"]), "message": F.col("app")})


@registered("det_rare", _SQL_RARE)
def det_rare(spark, sf_dir):
    return _text(detect.rare_signatures(_rare_events(spark, sf_dir), CFG))


@registered("det_all", f"SELECT * FROM ({_SQL_BRUTE}) UNION ALL SELECT * FROM ({_SQL_SPRAY}) UNION ALL SELECT * FROM ({_SQL_SPIKE})")
def det_all(spark, sf_dir):
    """All detectors over logins: those for requests find nothing there, and no signature is rare."""
    return _text(detect.run(logins(spark, sf_dir), CFG))


# --- order, limits and text formats ---


@registered("sort_limit", f"WITH {EV} SELECT row_number() OVER (ORDER BY ts_us, pos) - 1 AS pos, app, message FROM ev ORDER BY 1 LIMIT 100")
def sort_limit(spark, sf_dir):
    return tables.sort_by_time(events(spark, sf_dir)).orderBy("pos").limit(100).select("pos", "app", "message")


_JSON = f"""'{{"timestamp":"' || {ISO.format('ts_us')} || '","severity":"' || severity_name || '","source":"json","record_index":' || (pos + 1) || ',"host":"' || host || '","app":"' || app || '","user":"' || "user" || '","src_ip":"' || src_ip || '","message":"' || message || '","fields":{{"k":"' || k || '"}}}}'"""


@registered("export_ndjson", f"WITH {EV} SELECT {_JSON} AS value FROM ev")
def export_ndjson(spark, sf_dir):
    return sinks.ndjson(events(spark, sf_dir))


@registered("export_csv", f"WITH {EV} SELECT {ISO.format('ts_us')} || ',' || severity_name || ',json,' || (pos + 1) || ',' || host || ',' || app || ',,' || \"user\" || ',' || src_ip || ',,,,,,,,,,,' || message AS value FROM ev")
def export_csv(spark, sf_dir):
    return sinks.csv(events(spark, sf_dir))


@registered("export_filtered", f"WITH {EV} SELECT {_JSON} AS value FROM ev WHERE app = 'error' AND \"user\" = 'u3'")
def export_filtered(spark, sf_dir):
    return sinks.ndjson(query.where(events(spark, sf_dir), "severity=error AND user=u3"))



# --- parsers: a line is rendered from a table, parsed, and held against the table's columns ---


def _lined(rows: DataFrame, line) -> DataFrame:
    return rows.select(F.lit("t").alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("n").cast("bigint").alias("line_no"), line.alias("line"))


_TS = "make_timestamp(epoch_us(ts))"


@registered("parse_clf", f"SELECT event_id AS n, {IP} AS src_ip, 'u' || user_id AS \"user\", epoch_us(ts) // 1000000 * 1000000 AS ts_us, 'GET' AS http_method, '/p/' || event_id || '?t=' || event_type AS http_path, 200 + event_id % 400 AS http_status, event_id * 7 AS bytes, 'GET /p/' || event_id || '?t=' || event_type || ' -> ' || (200 + event_id % 400) AS message FROM events")
def parse_clf(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("n", F.col("event_id"))
    ip = F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    line = F.concat(ip, F.lit(" - u"), F.col("user_id"), F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /p/'), F.col("n"), F.lit("?t="), F.col("event_type"), F.lit(' HTTP/1.1" '), 200 + F.col("n") % 400, F.lit(" "), F.col("n") * 7)
    found = weblog.to_events(_lined(rows, line))
    return found.select(F.col("record_index").alias("n"), "src_ip", "user", "ts_us", "http_method", "http_path", "http_status", F.col("bytes").cast("bigint").alias("bytes"), "message")


@registered("parse_combined", "SELECT page_id AS n, url AS http_path, 'http://ref/' || page_id AS referer, 'agent \"' || page_id || '\"' AS user_agent FROM pages")
def parse_combined(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("n", F.col("page_id"))
    line = F.concat(F.lit('h - - [10/Oct/2000:13:55:36 -0700] "GET '), F.col("url"), F.lit(' HTTP/1.0" 200 5 "http://ref/'), F.col("n"), F.lit('" "agent \\"'), F.col("n"), F.lit('\\""'))
    found = weblog.parse(_lined(rows, line))
    return found.select(F.col("line_no").alias("n"), F.col("request.target").alias("http_path"), "referer", "user_agent")


@registered("parse_request_line", "SELECT page_id AS n, 'GET' AS method, url AS target, 'HTTP/1.1' AS version, true AS valid FROM pages")
def parse_request_line(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("r", weblog.request_line(F.concat(F.lit(" GET "), F.col("url"), F.lit("  HTTP/1.1"))))
    return rows.select(F.col("page_id").alias("n"), "r.*")


@registered("parse_decoded_path", "SELECT page_id AS n, regexp_extract(url, '^[^?#]*', 0) || ' é' AS path FROM pages")
def parse_decoded_path(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return rows.select(F.col("page_id").alias("n"), weblog.decoded_path(F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("+%c3%A9?x=%20"))).alias("path"))


@registered("parse_syslog3164", "SELECT event_id AS n, epoch_us(ts) // 1000000 * 1000000 AS ts_us, event_id % 8 AS severity, 'h' || (user_id % 8) AS host, event_type AS app, user_id AS pid, 'value ' || event_id AS message FROM events")
def parse_syslog3164(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("n", F.col("event_id"))
    line = F.concat(F.lit("<"), F.col("n") % 192, F.lit(">"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" h"), F.col("user_id") % 8, F.lit(" "), F.col("event_type"), F.lit("["), F.col("user_id"), F.lit("]: value "), F.col("n"))
    found = syslog.to_events(_lined(rows, line), 2024)
    return found.select(F.col("record_index").alias("n"), "ts_us", F.col("severity").cast("bigint").alias("severity"), "host", "app", "pid", "message")


@registered("parse_syslog5424", "SELECT event_id AS n, epoch_us(ts) AS ts_us, event_id % 8 AS severity, 'h' || (user_id % 8) AS host, event_type AS app, user_id AS pid, 'value ' || event_id AS message, 'm@1.k=' || json_extract_string(props, '$.k') || ';m@1.q=a]\"' AS fields FROM events")
def parse_syslog5424(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("n", F.col("event_id"))
    k = F.get_json_object("props", "$.k")
    line = F.concat(F.lit("<"), F.col("n") % 192, F.lit(">1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z h"), F.col("user_id") % 8, F.lit(" "), F.col("event_type"), F.lit(" "), F.col("user_id"), F.lit(' - [m@1 k="'), k, F.lit('" q="a\\]\\""] value '), F.col("n"))
    found = syslog.to_events(_lined(rows, line))
    fields = F.array_join(F.transform("fields", lambda f: F.concat(f["key"], F.lit("="), f["text"])), ";")
    return found.select(F.col("record_index").alias("n"), "ts_us", F.col("severity").cast("bigint").alias("severity"), "host", "app", "pid", "message", fields.alias("fields"))


@registered("parse_cef", f"SELECT event_id AS n, epoch_us(ts) // 1000 * 1000 AS ts_us, CASE WHEN event_id % 11 <= 3 THEN 6 WHEN event_id % 11 <= 6 THEN 4 WHEN event_id % 11 <= 8 THEN 3 ELSE 2 END AS severity, 'V|x ' || event_type AS provider, event_id % 1000 AS event_id, {IP} AS src_ip, 80 + user_id AS dst_port, 'u' || user_id AS \"user\", 'a=b value ' || event_id AS message FROM events")
def parse_cef(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("n", F.col("event_id"))
    ip = F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    ms = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1000)
    line = F.concat(F.lit("CEF:0|V\\|x|"), F.col("event_type"), F.lit("|1.0|"), F.col("n") % 1000, F.lit("|name|"), F.col("n") % 11, F.lit("|src="), ip, F.lit(" dpt="), 80 + F.col("user_id"), F.lit(" suser=u"), F.col("user_id"), F.lit(" msg=a\\=b value "), F.col("n"), F.lit(" rt="), ms)
    found = cef.to_events(_lined(rows, line))
    return found.select(F.col("record_index").alias("n"), "ts_us", F.col("severity").cast("bigint").alias("severity"), "provider", "event_id", "src_ip", "dst_port", "user", "message")


@registered("parse_json", "SELECT event_id AS n, epoch_us(ts) AS ts_us, CASE event_type WHEN 'error' THEN 3 ELSE 8 END AS severity, event_type AS message, 'h' || (user_id % 8) AS host, 'a.b=' || user_id || ';a.c.0=' || event_id || ';a.c.1=true' AS fields FROM events")
def parse_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("n", F.col("event_id"))
    line = F.concat(F.lit('{"@timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z","level":"'), F.col("event_type"), F.lit('","msg":"'), F.col("event_type"), F.lit('","host":"h'), F.col("user_id") % 8, F.lit('","a":{"b":'), F.col("user_id"), F.lit(',"c":['), F.col("n"), F.lit(",true]}}"))
    found = jsonl.to_events(_lined(rows, line))
    own = F.filter("fields", lambda f: f["key"].startswith("a."))
    fields = F.array_join(F.transform(own, lambda f: F.concat(f["key"], F.lit("="), f["text"])), ";")
    return found.select(F.col("line_no").alias("n"), "ts_us", F.col("severity").cast("bigint").alias("severity"), "message", "host", fields.alias("fields"))


# --- times ---


def _time(name: str, text: Callable, parse: Callable, unit: int) -> None:
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "events")
        return rows.select("event_id", parse(text()).cast("bigint").alias("ts_us"))

    registered(f"time_{name}", f"SELECT event_id, epoch_us(ts) // {unit} * {unit} AS ts_us FROM events")(run)


_time("iso", lambda: F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")), times.iso8601, 1)
_time("bsd", lambda: F.date_format("ts", "MMM d HH:mm:ss"), lambda c: times.bsd(c, 2024), 1000000)
_time("clf", lambda: F.concat(F.lit("["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000]")), times.clf, 1000000)
_time("any", lambda: F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.unix_timestamp("ts").cast("string")), times.any_time, 1000000)
_time("filetime", lambda: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) * 10 + F.lit(116444736000000000), times.filetime, 1)


@registered("time_offset", "SELECT event_id, epoch_us(ts) // 1000000 * 1000000 - 5400000000 AS ts_us FROM events")
def time_offset(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0130"))
    return table(spark, sf_dir, "events").select("event_id", times.iso8601(text).cast("bigint").alias("ts_us"))


@registered("time_to_iso", f"SELECT event_id, {ISO.format('epoch_us(ts)')} AS text FROM events")
def time_to_iso(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("pos").alias("event_id"), times.to_iso8601(F.col("ts_us")).alias("text"))


@registered("time_calendar", "SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m, day(last_day(o_orderdate)) AS n, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap FROM orders")
def time_calendar(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    return rows.select("y", "m", times.days_in_month(F.col("y"), F.col("m")).alias("n"), times.leap_year(F.col("y")).alias("leap"))


# --- texts ---


def _text_query(name: str, source: str, key: str, value: Callable, sql: str) -> None:
    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(key, value().alias("value"))

    registered(f"text_{name}", f"SELECT {key}, {sql} AS value FROM {source}")(run)


_text_query("truncate", "customer", "c_custkey", lambda: T.truncate(F.col("c_name"), 10), "CASE WHEN strlen(c_name) > 10 THEN left(c_name, 7) || '...' ELSE c_name END")
_text_query("sanitize", "nation", "n_nationkey", lambda: T.sanitize(F.concat("n_name", F.lit("\té\n"))), "n_name || '\\t\\xc3\\xa9\\n'")
_text_query("lower", "documents", "doc_id", lambda: F.md5(T.ascii_lower(F.col("text"))), "md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))")
_text_query("hex", "documents", "doc_id", lambda: F.md5(T.to_hex(F.encode("text", "UTF-8"))), "md5(lower(hex(encode(text))))")
_text_query("from_hex", "customer", "c_custkey", lambda: T.from_hex(T.to_hex(F.encode("c_name", "UTF-8"))).cast("string"), "c_name")
_text_query("base64", "documents", "doc_id", lambda: F.md5(T.base64_decode(F.base64(F.encode("text", "UTF-8")))), "md5(text)")
_text_query("percent", "customer", "c_custkey", lambda: T.percent_decode(F.concat(F.replace("c_name", F.lit("#"), F.lit("%23")), F.lit("+%zz%"))), "c_name || ' %zz%'")
_text_query("utf8", "documents", "doc_id", lambda: T.valid_utf8(F.col("text")), "true")
_text_query("trim", "nation", "n_nationkey", lambda: T.trim(F.concat(F.lit(" \t\n"), F.col("n_name"), F.lit("\f\r "))), "n_name")
_text_query("integers", "orders", "o_orderkey", lambda: T.parse_i64(F.concat(F.lit("-"), F.col("o_orderkey"))), "-o_orderkey")
_text_query("unsigned", "orders", "o_orderkey", lambda: T.parse_u64(F.concat(F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(" "))).cast("bigint"), "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END")
_text_query("split", "pages", "page_id", lambda: F.array_join(T.split(F.col("url"), "/", True), "|"), "array_to_string(list_filter(string_split(url, '/'), lambda x: x <> ''), '|')")
_text_query("utf16", "nation", "n_nationkey", lambda: T.utf16le(F.encode("n_name", "UTF-16LE")), "n_name")


_text_query("iequals", "nation", "n_nationkey", lambda: T.iequals(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise("x")), "n_nationkey % 2 = 0")
_text_query("affixes", "pages", "page_id", lambda: F.concat_ws(" ", *(f.cast("int").cast("string") for f in (T.starts_with(F.col("url"), "https"), T.ends_with(F.col("url"), "1"), T.contains(F.col("url"), "www")))), "concat_ws(' ', starts_with(url, 'https')::int, suffix(url, '1')::int, contains(url, 'www')::int)")
_text_query("replace", "customer", "c_custkey", lambda: T.replace_all(F.col("c_name"), "#", "--"), "replace(c_name, '#', '--')")
_text_query("join", "pages", "page_id", lambda: T.join(F.split("url", "/"), "-+-"), "replace(url, '/', '-+-')")
_text_query("lines", "documents", "doc_id", lambda: F.size(T.split_lines(F.col("text"))).cast("bigint"), "CAST(len(string_split(text, chr(10))) - CASE WHEN text = '' OR right(text, 1) = chr(10) THEN 1 ELSE 0 END AS BIGINT)")
_text_query("json_escape", "documents", "doc_id", lambda: F.md5(F.concat(F.lit('"'), sinks.json_escape(F.col("text")), F.lit('"'))), "md5(CAST(to_json(text) AS VARCHAR))")
_text_query("csv_quote", "documents", "doc_id", lambda: F.md5(sinks.csv_quote(F.col("text"))), "md5(CASE WHEN regexp_matches(text, '[,\"\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END)")
_text_query("facility", "nation", "n_nationkey", lambda: schema.facility_name(F.col("n_nationkey")), f"coalesce({list(schema.FACILITIES)}[n_nationkey + 1], 'unknown')")


def _kinds(c):
    return F.concat_ws(" ", *(f(c).cast("int").cast("string") for f in (T.is_space, T.is_digit, T.is_hex, T.is_alpha, T.is_alnum)))


_CHAR = "substr(url, CAST(page_id % 20 + 1 AS INT), 1)"
_text_query("kinds", "pages", "page_id", lambda: _kinds(F.substring(F.col("url"), (F.col("page_id") % 20 + 1).cast("int"), F.lit(1))), "concat_ws(' ', " + ", ".join(f"regexp_matches({_CHAR}, '^[{k}]$')::int" for k in (" \\t", "0-9", "0-9A-Fa-f", "A-Za-z", "A-Za-z0-9")) + ")")


# --- formats and binary logs ---


@registered("detect_format", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'syslog' WHEN 2 THEN 'cef' WHEN 3 THEN 'web' ELSE 'evtx' END AS format FROM events")
def detect_format(spark, sf_dir):
    heads = ("  {\"a\":1}", "<34>Oct 11 22:14:15 h su: x", "<1>h CEF:0|a|b|c|d|e|5|", 'h - - [x] "GET / HTTP/1.1" 200 1', "ElfFile")
    head = F.get(F.array(*map(F.lit, heads)), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", formats.detect_format(F.encode(head, "UTF-8")).alias("format"))


@registered("evtx_records", "SELECT 1 + n_nationkey AS record_index, 1001 + n_nationkey AS event_id, n_name AS host, 'Sec' AS channel, 3 AS severity, 'Sec EventID=' || (1001 + n_nationkey) || ' ' || n_name AS message FROM nation")
def evtx_records(spark, sf_dir):
    """One file is made of the table's rows, and read again."""
    rows = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("n"), "n_name")
    files = rows.groupBy((F.col("n") % 3).alias("k")).agg(F.array_sort(F.collect_list(F.struct("n", "n_name"))).alias("rows"))
    made = files.select(F.concat(F.lit("f"), "k").alias("file"), evtx_fixture.file_column(F.col("rows")).alias("content"))
    return evtx.to_events(made).select("record_index", "event_id", "host", "channel", F.col("severity").cast("bigint").alias("severity"), "message")


@registered("stats_first_keys", f"WITH {EV}, c AS (SELECT app AS key, count(*) AS count, min(pos) AS since FROM ev GROUP BY app) SELECT key, count FROM c ORDER BY since LIMIT 3")
def stats_first_keys(spark, sf_dir):
    return stats.first_keys(events(spark, sf_dir), "app", 3)


@registered("det_evidence", f"WITH a AS ({_SQL_SPIKE}), b AS (SELECT unnest(string_split(evidence, ','))::BIGINT AS pos FROM a) SELECT 'severity-spike' AS kind, pos, event_type AS app FROM b JOIN events ON event_id = pos")
def det_evidence(spark, sf_dir):
    rows = events(spark, sf_dir)
    return detect.evidence(detect.severity_spikes(rows, CFG), rows).select("kind", "pos", "app")

"""Batch forms of the live view (family G)."""

from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.catalog.base import add, big, on_activity, on_flows, over_activity, over_flows
from flowloom.sources import sample_views as V
from flowloom.streaming import live as G

U, T = '"user"', '"timestamp"'
_susp = ", ".join(map(str, S.SUSPICIOUS_PORTS))


def _zoned(spark, sf):
    """Flows with zoned time, as a stream carries them; the zone cancels out in the result."""
    return V.flows(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def _plain(frame, column="ts"):
    return frame.withColumn(column, F.col(column).cast("timestamp_ntz"))


_WALK = """hits AS (
  SELECT src_ip, epoch_us("timestamp") AS us, dst_port AS port, row_number() OVER (PARTITION BY src_ip ORDER BY "timestamp", flow_id) AS n
  FROM flows WHERE src_ip IS NOT NULL AND "timestamp" IS NOT NULL),
walk AS (
  SELECT src_ip, n, us, [{'t': us, 'p': port}] AS seen, 0 AS fired FROM hits WHERE n = 1
  UNION ALL
  SELECT src_ip, n, us, CASE WHEN len(now) >= 6 THEN now[1:0] ELSE now END, CASE WHEN len(now) >= 6 THEN len(now) ELSE 0 END FROM (
    SELECT h.src_ip, h.n, h.us, list_append(list_filter(w.seen, lambda x: x.t >= h.us - 30000000 AND x.p <> h.port),
                                            {'t': h.us, 'p': h.port}) AS now
    FROM walk w JOIN hits h ON h.src_ip = w.src_ip AND h.n = w.n + 1))"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


add("g2_running_totals", lambda spark, sf: G.running_totals(V.flows(spark, sf)), _recursive(on_flows(
    f"SELECT count(*) AS events, {big('sum(bytes)')} AS total_bytes, count(DISTINCT {U}) AS unique_users, count(DISTINCT src_ip) AS unique_src_ips, "
    f"{big(f'count(*) FILTER (bytes >= 50000) + count(*) FILTER (dst_port IN ({_susp})) + (SELECT count(*) FROM walk WHERE fired > 0)')} AS alerts, "
    f"max({T}) AS last_event_at FROM flows", _WALK)))
add("g4_port_scan_alerts", over_flows(G.port_scan_alerts), _recursive(on_flows(
    "SELECT make_timestamp(us) AS ts, 'high' AS level, 'port_scan' AS title, src_ip AS entity, fired || ' ports in 30 s' AS detail "
    "FROM walk WHERE fired > 0", _WALK)))
_buckets = (f"b AS (SELECT time_bucket(INTERVAL '5 seconds', {T}) AS ts, {big('sum(bytes)')} AS bytes, count(*) AS events "
            "FROM flows GROUP BY 1)")
add("g3_traffic_buckets", lambda spark, sf: _plain(G.traffic_buckets(_zoned(spark, sf))), on_flows("SELECT * FROM b", _buckets))
add("g3_latest_buckets", lambda spark, sf: _plain(G.latest_buckets(G.traffic_buckets(_zoned(spark, sf)))), on_flows(
    "SELECT s AS ts, coalesce(bytes, 0) AS bytes, coalesce(events, 0) AS events FROM (SELECT unnest(generate_series("
    "(SELECT min(ts) FROM b WHERE ts > (SELECT max(ts) FROM b) - INTERVAL '150 seconds'), (SELECT max(ts) FROM b), "
    "INTERVAL '5 seconds')) AS s) LEFT JOIN b ON b.ts = s", _buckets))
_alert = "SELECT {t} AS ts, 'medium' AS level, '{title}' AS title, {entity} AS entity, {detail} AS detail FROM flows WHERE {test}"
_LARGE = _alert.format(t=T, title="large_flow", entity=U, detail="bytes || ' bytes to ' || dst_ip || ':' || dst_port",
                       test="bytes >= 50000")
_PORT = _alert.format(t=T, title="sensitive_port", entity=f"{U} || ' / ' || src_ip", detail="'port ' || dst_port",
                      test=f"dst_port IN ({_susp})")
add("g5_large_flows", over_flows(G.large_flows), on_flows(_LARGE))
add("g6_sensitive_ports", over_flows(G.sensitive_ports), on_flows(_PORT))
add("g7_alert_history",
    lambda spark, sf: G.alert_history(G.large_flows(V.flows(spark, sf)).unionByName(G.sensitive_ports(V.flows(spark, sf)))),
    on_flows(f"SELECT * FROM ({_LARGE} UNION ALL {_PORT}) ORDER BY ts DESC, entity, title, detail LIMIT 500"))
add("g8_recent_events", over_flows(G.recent_events), on_flows(f"SELECT * FROM flows ORDER BY {T} DESC, flow_id DESC LIMIT 20"))
add("g9_port_scan_windows", over_flows(G.port_scan_windows), on_flows(
    f"SELECT flow_id, src_ip, dst_port, ports FROM (SELECT *, len(list_distinct(list(dst_port) OVER (PARTITION BY src_ip ORDER BY {T} "
    "RANGE BETWEEN INTERVAL '30' SECOND PRECEDING AND CURRENT ROW))) AS ports FROM flows) WHERE ports >= 6"))
add("g10_event_rate", lambda spark, sf: _plain(G.event_rate(_zoned(spark, sf))), on_flows(
    "SELECT ts, CAST(count(*) AS DOUBLE) / CAST(5 AS DOUBLE) AS events_per_second FROM (SELECT "
    f"unnest([time_bucket(INTERVAL '1 second', {T}) + i * INTERVAL '1 second' FOR i IN [1, 2, 3, 4, 5]]) AS ts FROM flows) GROUP BY 1"))


def _count(section: str, value: str, limit: int | None) -> str:
    cut = f"AND trim({value}) <> '' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT {limit}" if limit else "GROUP BY 2"
    name = f"trim({value})" if limit else value
    return f"(SELECT '{section}' AS section, {name} AS name, count(*) AS amount FROM activity_flows WHERE true {cut})"


add("g11_session_status", over_activity(G.session_status), on_activity(" UNION ALL ".join([
    _count("category", "app_category", None),
    _count("activity", "CASE WHEN activity <> '' THEN activity ELSE 'unrecognised' END", None),
    _count("host", "coalesce(nullif(hostname, ''), nullif(dns_query, ''), tls_sni)", 10),
    _count("process", "process_name", 10),
    "(SELECT 'distinct_ips', '', count(*) FROM (SELECT src_ip FROM activity_flows UNION SELECT dst_ip FROM activity_flows))",
    "(SELECT 'total_packets', '', count(*) FROM activity_flows)",
    f"(SELECT 'total_bytes', '', {big('sum(bytes)')} FROM activity_flows)",
    f"(SELECT 'download', strftime({T}, '%Y-%m-%d %H:%M:%S') || '|' || download_name || '|' || CASE WHEN hostname <> '' THEN hostname ELSE src_ip END "
    f"|| '|' || content_type, bytes FROM activity_flows WHERE trim(download_name) <> '' ORDER BY {T} DESC, flow_id DESC LIMIT 10)",
    f"(SELECT 'recent_flow', concat_ws('|', strftime({T}, '%Y-%m-%d %H:%M:%S'), src_ip, src_port, dst_ip, dst_port, protocol, {U}), bytes "
    f"FROM activity_flows ORDER BY {T} DESC, flow_id DESC LIMIT 20)"])))

"""Traffic aggregates (family B)."""

from flowloom import schema as S
from flowloom.catalog.base import add, big, half_up, on_activity, on_flows, over_activity, over_flows, pct, seconds
from flowloom.operators import traffic as B

U, T = '"user"', '"timestamp"'
HOUR = f"CAST(hour({T}) AS INTEGER)"
LABEL = f"lpad(CAST(hour({T}) AS VARCHAR), 2, '0') || ':00'"


def _top(key: str, n: int, alias: str | None = None) -> str:
    name = alias or key
    return on_flows(f"SELECT {key} AS {name}, {big('sum(bytes)')} AS bytes FROM flows GROUP BY 1 "
                    f"ORDER BY 2 DESC, 1 LIMIT {n}")


def _spine(step: str, bucket: str, measures: str, zero: str) -> list[str]:
    return [f"h AS (SELECT {bucket} AS time, {measures} FROM flows GROUP BY 1)",
            f"spine AS (SELECT unnest(generate_series(min(time), max(time), INTERVAL '{step}')) AS time FROM h)",
            f"filled AS (SELECT spine.time, {zero} FROM spine LEFT JOIN h USING (time))"]


add("b1_totals", over_flows(B.totals), on_flows(
    f"SELECT {big('sum(bytes)')} AS total_bytes, count(*) AS total_packets, count(DISTINCT {U}) AS unique_users, "
    "count(DISTINCT src_ip) + count(DISTINCT dst_ip) AS src_plus_dst_ips FROM flows"))
add("b2_top_users", over_flows(B.top_users, 10), _top(U, 10))
add("b3_top_users_by_rows", over_flows(B.top_users_by_rows, 10), on_flows(
    f"SELECT {U}, count({T}) AS packets FROM flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
add("b4_protocol_counts", over_flows(B.protocol_counts), on_flows(
    "SELECT protocol, count(*) AS packets FROM flows GROUP BY 1"))
_span = seconds(f"min({T})", f"max({T})")
add("b5_bandwidth", over_flows(B.bandwidth), on_flows(
    f"SELECT {half_up(f'CAST(sum(bytes) AS DOUBLE) / {_span}', 2)} AS bytes_per_second, "
    f"{half_up(_span, 2)} AS total_seconds FROM flows"))
add("b6_session_span", over_flows(B.session_span), on_flows(
    f"SELECT {half_up('CAST(sum(us) AS DOUBLE) / CAST(count(*) AS DOUBLE) / CAST(1000000 AS DOUBLE)', 2)} AS avg_seconds, "
    f"{half_up('CAST(min(us) AS DOUBLE) / CAST(1000000 AS DOUBLE)', 2)} AS min_seconds, "
    f"{half_up('CAST(max(us) AS DOUBLE) / CAST(1000000 AS DOUBLE)', 2)} AS max_seconds, "
    f"count(*) AS total_sessions FROM (SELECT {U}, epoch_us(max({T})) - epoch_us(min({T})) AS us FROM flows GROUP BY 1)"))
add("b7_category_bytes", over_flows(B.category_bytes), on_flows(
    f"SELECT app_category, {big('sum(bytes)')} AS bytes FROM flows GROUP BY 1"))
add("b8_traffic_trend", over_flows(B.trend, "hour"), on_flows(
    "SELECT * FROM filled", *_spine("1 hour", f"CAST(date_trunc('hour', {T}) AS TIMESTAMP)",
                                    f"{big('sum(bytes)')} AS bytes", "coalesce(bytes, 0) AS bytes")))
add("b8_traffic_trend_5min", over_flows(B.trend, "5min"), on_flows(
    "SELECT * FROM filled", *_spine("5 minutes", f"time_bucket(INTERVAL '5 minutes', {T})",
                                    f"{big('sum(bytes)')} AS bytes", "coalesce(bytes, 0) AS bytes")))
add("b9_active_hours", over_flows(B.active_hours), on_flows(
    f"SELECT {LABEL} AS hour, count(DISTINCT {U}) AS active_users, {big('sum(bytes)')} AS total_bytes, "
    f"count({T}) AS packet_count FROM flows GROUP BY 1"))
add("b10_user_categories", over_flows(B.user_categories), on_flows(
    f"SELECT {U}, app_category, {big('sum(bytes)')} AS bytes FROM flows GROUP BY 1, 2"))
add("b11_protocol_bytes", over_flows(B.protocol_bytes), on_flows(
    f"SELECT protocol, {big('sum(bytes)')} AS bytes FROM flows GROUP BY 1"))


def _section(name: str, column: str) -> str:
    return (f"(SELECT '{name}' AS section, trim({column}) AS name, count(*) AS amount FROM activity_flows "
            f"WHERE trim({column}) <> '' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)")


add("b12_activity_summary", over_activity(B.activity_summary), on_activity(
    " UNION ALL ".join([_section("host", "hostname"), _section("process", "process_name"),
                        _section("activity", "activity")])
    + " UNION ALL (SELECT 'download', download_name || '|' || CASE WHEN hostname <> '' THEN hostname ELSE src_ip END, "
    f"bytes FROM activity_flows WHERE trim(download_name) <> '' ORDER BY {T} DESC, flow_id DESC LIMIT 20)"))
add("b12_recent_downloads", over_activity(B.recent_downloads), on_activity(
    f"SELECT {T} AS time, download_name AS name, CASE WHEN hostname <> '' THEN hostname ELSE src_ip END AS source, "
    f"content_type, bytes FROM activity_flows WHERE trim(download_name) <> '' ORDER BY {T} DESC, flow_id DESC LIMIT 20"))
add("b13_top_talkers", over_flows(B.top_talkers, 10), _top("src_ip", 10))
add("b14_date_range", over_flows(B.date_range, "2024-01-05", "2024-01-20"), on_flows(
    f"SELECT * FROM flows WHERE CAST({T} AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"))
add("b15_hourly_averages", over_flows(B.hourly_averages), on_flows(
    f"SELECT {LABEL} AS hour, {half_up('CAST(sum(bytes) AS DOUBLE) / CAST(count(bytes) AS DOUBLE)', 4)} AS avg_bytes "
    "FROM flows GROUP BY 1"))
_daily = (f"daily AS (SELECT CAST({T} AS DATE) AS date, {big('sum(bytes)')} AS total_bytes, "
          "count(*) AS total_packets FROM flows GROUP BY 1)")
add("b16_daily_totals", over_flows(B.daily_totals), on_flows("SELECT * FROM daily", _daily))
add("b17_growth", over_flows(B.growth), on_flows(
    "SELECT coalesce((SELECT CASE WHEN p IS NOT NULL AND p <> 0 THEN "
    + half_up("CAST(total_bytes - p AS DOUBLE) / CAST(p AS DOUBLE) * CAST(100 AS DOUBLE)", 2)
    + " END FROM (SELECT date, total_bytes, lag(total_bytes) OVER (ORDER BY date) AS p FROM daily) "
    "ORDER BY date DESC LIMIT 1), CAST(0 AS DOUBLE)) AS growth_pct", _daily))
add("b18_exact_sample", over_flows(B.exact_sample, 0.1, 7), on_flows(
    "SELECT * FROM flows ORDER BY md5('7:' || flow_id) LIMIT "
    "(SELECT greatest(CAST(floor(count(*) * CAST(0.1 AS DOUBLE)) AS BIGINT), 1) FROM flows)"))
add("b19_user_count", over_flows(B.user_count), on_flows(f"SELECT count(DISTINCT {U}) AS unique_users FROM flows"))
add("b20_top_ports", over_flows(B.top_ports, 10), _top("dst_port", 10, "port"))
add("b21_tls_share", over_flows(B.tls_share), on_flows(
    f"SELECT {pct('sum(CASE WHEN dst_port = 443 THEN bytes ELSE 0 END)', 'sum(bytes)')} AS tls_pct FROM flows"))
add("b22_packet_size_stats", over_flows(B.packet_size_stats), on_flows(
    "SELECT CAST(min(bytes) AS DOUBLE) AS min, CAST(max(bytes) AS DOUBLE) AS max, "
    f"{half_up('CAST(sum(bytes) AS DOUBLE) / CAST(count(bytes) AS DOUBLE)', 2)} AS avg, "
    "CAST(median(bytes) AS DOUBLE) AS median FROM flows"))
add("b23_hourly_users", over_flows(B.hourly_users), on_flows(
    f"SELECT {LABEL} AS hour, count(DISTINCT {U}) AS active_users FROM flows GROUP BY 1"))
add("b24_concurrent_users", over_flows(B.concurrent_users), on_flows(
    f"SELECT CAST({T} AS DATE) AS date, {LABEL} AS hour, count(DISTINCT {U}) AS active_users FROM flows GROUP BY 1, 2"))
add("b25_peak_hour", over_flows(B.peak_hour), on_flows(
    f"SELECT {HOUR} AS hour, {big('sum(bytes)')} AS bytes FROM flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"))
# A threshold at the scale of one busy hour, so that the result is not empty.
add("b26_idle_hours", over_flows(B.idle_hours, 45_000_000), on_flows(
    "SELECT CAST(r.h AS INTEGER) AS hour FROM range(24) AS r(h) LEFT JOIN "
    f"(SELECT {HOUR} AS hour, sum(bytes) AS b FROM flows GROUP BY 1) x ON x.hour = r.h WHERE coalesce(b, 0) <= 45000000"))
add("b27_heatmap", over_flows(B.heatmap), on_flows(
    f"SELECT CAST(isodow({T}) - 1 AS INTEGER) AS day_of_week, {HOUR} AS hour, {big('sum(bytes)')} AS bytes "
    "FROM flows GROUP BY 1, 2"))
add("b28_anomaly_timeline", over_flows(B.anomaly_timeline), on_flows(
    "SELECT time, total_bytes, packet_count, "
    + half_up("least(CAST(1 AS DOUBLE), abs(CAST(total_bytes AS DOUBLE) - m) / (s * CAST(3 AS DOUBLE)))", 4)
    + " AS anomaly_score FROM filled, (SELECT avg(CAST(total_bytes AS DOUBLE)) AS m, "
    "CASE WHEN coalesce(stddev_samp(CAST(total_bytes AS DOUBLE)), 0) = 0 THEN CAST(1 AS DOUBLE) "
    "ELSE stddev_samp(CAST(total_bytes AS DOUBLE)) END AS s FROM filled)",
    *_spine("1 hour", f"CAST(date_trunc('hour', {T}) AS TIMESTAMP)",
            f"{big('sum(bytes)')} AS total_bytes, count(*) AS packet_count",
            "coalesce(total_bytes, 0) AS total_bytes, coalesce(packet_count, 0) AS packet_count")))
_pair = [
    f"pair AS (SELECT * FROM flows WHERE {U} IN ('user_7', 'user_8'))",
    f"long AS (SELECT {U} AS u, 'total_bytes' AS metric, '' AS key, {big('sum(bytes)')} AS v FROM pair GROUP BY 1 "
    f"UNION ALL SELECT {U}, 'total_packets', '', count(*) FROM pair GROUP BY 1 "
    f"UNION ALL SELECT {U}, 'active_hours', '', count(DISTINCT hour({T})) FROM pair GROUP BY 1 "
    f"UNION ALL SELECT {U}, 'protocol_bytes', protocol, {big('sum(bytes)')} FROM pair GROUP BY 1, 3 "
    f"UNION ALL SELECT {U}, 'category_bytes', app_category, {big('sum(bytes)')} FROM pair GROUP BY 1, 3)"]
add("b29_compare_users", over_flows(B.compare_users, "user_7", "user_8"), on_flows(
    "SELECT metric, key, coalesce(max(CASE WHEN u = 'user_7' THEN v END), 0) AS user_a, "
    "coalesce(max(CASE WHEN u = 'user_8' THEN v END), 0) AS user_b, "
    "coalesce(max(CASE WHEN u = 'user_7' THEN v END), 0) - coalesce(max(CASE WHEN u = 'user_8' THEN v END), 0) AS diff "
    "FROM long GROUP BY 1, 2", *_pair))
add("b30_weekday_split", over_flows(B.weekday_split), on_flows(
    f"SELECT dayname(any_value({T})) AS day, {big('sum(bytes)')} AS day_bytes, "
    f"(SELECT {big('coalesce(sum(bytes), 0)')} FROM flows WHERE isodow({T}) <= 5) AS weekday_bytes, "
    f"(SELECT {big('coalesce(sum(bytes), 0)')} FROM flows WHERE isodow({T}) > 5) AS weekend_bytes "
    f"FROM flows GROUP BY isodow({T})"))
add("b31_bytes_per_row", over_flows(B.bytes_per_row), on_flows(
    f"SELECT {half_up('CAST(sum(bytes) AS DOUBLE) / CAST(count(*) AS DOUBLE)', 2)} AS bytes_per_packet FROM flows"))
add("b32_devices_per_user", over_flows(B.devices_per_user), on_flows(
    f"SELECT {U}, count(DISTINCT src_ip) AS devices FROM flows GROUP BY 1"))
add("b33_top_categories", over_flows(B.top_categories, 5), _top("app_category", 5))
_families = " UNION ALL ".join(f"SELECT unnest({ports}) AS p, '{name}' AS family" for name, ports in S.PORT_FAMILIES.items())
add("b34_family_bytes", over_flows(B.family_bytes), on_flows(
    f"SELECT coalesce(family, 'other') AS family, {big('sum(bytes)')} AS bytes, count(*) AS packets "
    "FROM flows LEFT JOIN fam ON fam.p = flows.dst_port GROUP BY 1", f"fam AS ({_families})"))

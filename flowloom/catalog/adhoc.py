"""Ad-hoc reports (family H) and scalar helpers (family I)."""

from pyspark.sql import functions as F


from flowloom.catalog.base import add, big, half_up, on_flows, over_flows, pct
from flowloom.catalog.profiles import BROAD
from flowloom.catalog.security import ALL_ALERTS
from flowloom.functions import scalars as X
from flowloom.operators import adhoc as H
from flowloom.operators import rules as R
from flowloom.sources import sample_views as V

U, T = '"user"', '"timestamp"'
_q = ", ".join(f"{half_up(f'quantile_cont(bytes, {p})', 4)} AS {n}" for n, p in H.QUANTILES.items())
add("h1_detailed_stats", over_flows(H.detailed_stats), on_flows(
    f"SELECT {big('sum(bytes)')} AS total_bytes, count(*) AS total_packets, count(DISTINCT {U}) AS unique_users, "
    f"{half_up('CAST(sum(bytes) AS DOUBLE) / CAST(count(DISTINCT ' + U + ') AS DOUBLE)', 2)} AS per_user_avg_bytes, "
    f"{half_up('quantile_cont(bytes, 0.5)', 4)} AS median_traffic_bytes, {_q} FROM flows"))
_cols = "flow_id,timestamp,src_ip,dst_ip,src_port,dst_port,protocol,bytes,app_category,user,payload"
add("h2_data_info", over_flows(H.data_info), on_flows(
    f"SELECT count(*) AS row_count, min({T}) AS range_start, max({T}) AS range_end, count(DISTINCT {U}) AS unique_users, "
    f"{big('sum(bytes)')} AS total_bytes, '{_cols}' AS columns FROM flows"))
add("h3_random_rows", over_flows(H.random_rows, 25, 3), on_flows("SELECT * FROM flows ORDER BY md5('3:' || flow_id) LIMIT 25"))
_hit = (f"contains(lower({U}), '$') OR contains(src_ip, '$') OR contains(dst_ip, '$') OR contains(lower(app_category), '$')")
add("h4_search_totals", over_flows(H.search_totals, "Game"), on_flows(
    f"SELECT count(*) AS total_matches, {big('coalesce(sum(bytes), 0)')} AS total_bytes, count(DISTINCT {U}) AS unique_users "
    f"FROM flows WHERE {_hit.replace('$', 'game')}"))
add("h4_search_rows", over_flows(H.search_rows, "198.18.3."), on_flows(
    f"SELECT * FROM flows WHERE {_hit.replace('$', '198.18.3.')} ORDER BY flow_id LIMIT 50"))
_re = (f"regexp_matches(lower({U}), '$') OR regexp_matches(src_ip, '$') OR regexp_matches(dst_ip, '$') OR regexp_matches(lower(app_category), '$')")
add("h4_search_regex", over_flows(H.search_totals, "user_1[0-9]$", True), on_flows(
    f"SELECT count(*) AS total_matches, {big('coalesce(sum(bytes), 0)')} AS total_bytes, count(DISTINCT {U}) AS unique_users "
    f"FROM flows WHERE {_re.replace(chr(36), 'user_1[0-9]' + chr(36))}"))
add("h5_timeline", over_flows(H.timeline, "2024-01-03 00:00:00", "2024-01-12 12:30:00"), on_flows(
    "SELECT time, coalesce(bytes, 0) AS bytes FROM (SELECT unnest(generate_series(min(time), max(time), INTERVAL '1 hour')) AS time "
    "FROM h) LEFT JOIN h USING (time)",
    f"h AS (SELECT CAST(date_trunc('hour', {T}) AS TIMESTAMP) AS time, {big('sum(bytes)')} AS bytes FROM flows "
    f"WHERE {T} BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-12 12:30:00' GROUP BY 1)"))
add("h6_topology_edges", over_flows(H.topology_edges), on_flows(
    f"SELECT src_ip AS source, dst_ip AS target, count(*) AS connections, {big('sum(bytes)')} AS bytes FROM flows GROUP BY 1, 2"))
add("h6_topology_nodes", over_flows(H.topology_nodes), on_flows(
    "SELECT 'source' AS role, src_ip AS ip, count(DISTINCT dst_ip) AS degree, count(*) AS connections FROM flows GROUP BY 2 "
    "UNION ALL SELECT 'destination', dst_ip, count(DISTINCT src_ip), count(*) FROM flows GROUP BY 2"))
add("h7_protocol_table", over_flows(H.protocol_table), on_flows(
    f"SELECT protocol, {big('b')} AS bytes, n AS packet_count, {pct('b', '(SELECT sum(bytes) FROM flows)')} AS percentage "
    f"FROM (SELECT protocol, sum(bytes) AS b, count({T}) AS n FROM flows GROUP BY 1)"))
add("h8_user_card", over_flows(H.user_card), on_flows(
    f"SELECT {U}, {big('sum(bytes)')} AS total_bytes, count(*) AS packet_count, count(DISTINCT dst_ip) AS unique_destinations, "
    f"min({T}) AS range_start, max({T}) AS range_end FROM flows GROUP BY 1"))
add("h8_user_card_sections", over_flows(H.user_card_sections), on_flows(
    f"SELECT {U}, 'hour' AS section, printf('%02d:00', hour({T})) AS name, {big('sum(bytes)')} AS bytes, count(*) AS packets FROM flows GROUP BY 1, 3 "
    f"UNION ALL SELECT {U}, 'category', app_category, {big('sum(bytes)')}, count(*) FROM flows GROUP BY 1, 3"))
add("h9_user_full_report", over_flows(H.user_full_report))
_dbl = "CAST({} AS DOUBLE)".format
_span = f"{_dbl(f'epoch_us(max({T})) - epoch_us(min({T}))')} / 1000000 / 3600"
_MEASURES = {
    "total_bytes": _dbl("b"), "packet_count": _dbl("n"), "unique_destinations": _dbl("d"), "encrypted_packets": _dbl("tls"),
    "unencrypted_packets": _dbl("n - tls"), "encryption_ratio": pct("tls", "n"),
    "connections_per_hour": f"CASE WHEN h > 0 THEN {half_up('n / h', 2)} ELSE 0 END", "total_hours": f"CASE WHEN h > 0 THEN {half_up('h', 2)} ELSE 0 END",
    "peak_bytes_per_second": half_up("CAST(mh AS DOUBLE) / 3600", 2), "peak_hour": _dbl("ph"), "total_peak_bytes": _dbl("mh"),
    "unique_protocols": _dbl("p"), "download_bytes": _dbl("down"), "upload_bytes": _dbl("up"),
    "ratio": f"CASE WHEN up > 0 THEN {half_up('CAST(down AS DOUBLE) / up', 2)} END"}
_CARD = f"""card AS (
  SELECT a.{U}, a.b, a.n, a.d, a.tls, a.h, a.p, a.down, a.up, m.mh, m.ph FROM (
    SELECT {U}, sum(bytes) AS b, count(*) AS n, count(DISTINCT dst_ip) AS d, count(*) FILTER (dst_port = 443) AS tls, {_span} AS h,
      count(DISTINCT protocol) AS p, coalesce(sum(bytes) FILTER (dst_port >= 1024), 0) AS down, coalesce(sum(bytes) FILTER (dst_port < 1024), 0) AS up
    FROM flows GROUP BY 1) a
  JOIN (SELECT {U}, max(x) AS mh, arg_max(hh, x * 100 - hh) AS ph FROM (
    SELECT {U}, hour({T}) AS hh, sum(bytes) AS x FROM flows GROUP BY 1, 2) GROUP BY 1) m ON m.{U} = a.{U})"""
add("h9_report_sections", lambda spark, sf: H.report_sections(V.flows(spark, sf)).where("section <> 'tag'"), on_flows(" UNION ALL ".join([
    *(f"SELECT {U}, 'measure' AS section, '{name}' AS name, {sql} AS amount FROM card WHERE ({sql}) IS NOT NULL" for name, sql in _MEASURES.items()),
    f"SELECT DISTINCT {U}, 'protocol', protocol, CAST(1 AS DOUBLE) FROM flows",
    f"SELECT {U}, 'category', app_category, {_dbl('sum(bytes)')} FROM flows GROUP BY 1, 3",
    f"SELECT {U}, 'hour_bytes', printf('%02d:00', hour({T})), {_dbl('sum(bytes)')} FROM flows GROUP BY 1, 3",
    f"SELECT {U}, 'hour_packets', printf('%02d:00', hour({T})), {_dbl('count(*)')} FROM flows GROUP BY 1, 3",
    f"(SELECT NULL, 'traffic_ranking', {U}, {_dbl('sum(bytes)')} FROM flows GROUP BY 3 ORDER BY 4 DESC, 3 LIMIT 10)",
    f"SELECT NULL, 'protocol_distribution', protocol, {_dbl('sum(bytes)')} FROM flows GROUP BY 3",
    f"SELECT NULL, 'app_category', app_category, {_dbl('sum(bytes)')} FROM flows GROUP BY 3"]), _CARD))
add("h12_per_file_totals",
    lambda spark, sf: spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "*", "cast(floor(value * 1000) AS bigint) AS bytes", "cast(user_id AS string) AS user").transform(
        lambda d: H.per_file_totals(d)),
    "SELECT 'events.parquet' AS file, count(*) AS records, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS total_bytes, "
    "count(DISTINCT user_id) AS unique_users FROM events")
add("h13_profile_search", over_flows(H.profile_search, "R_1"), on_flows(
    f"SELECT DISTINCT {U} FROM flows WHERE contains(lower({U}), 'r_1')"))
add("h13_profile_search_blank", over_flows(H.profile_search, "", 12), on_flows(f"SELECT DISTINCT {U} FROM flows ORDER BY 1 LIMIT 12"))
add("g12_alert_text_filter", lambda spark, sf: H.alert_search(R.all_alerts(V.flows(spark, sf)), "Sensitive_Service SSH"), on_flows(
    "SELECT * FROM alerts WHERE contains(lower(type || ' ' || severity || ' ' || title || ' ' || entity || ' ' || evidence), "
    "'sensitive_service ssh')", *ALL_ALERTS))

# --- scalar helpers ------------------------------------------------------------------------
_b = "CAST(bytes AS DOUBLE)"


def _unit(power: int, name: str) -> str:
    return f"printf('%.2f', {half_up(f'{_b} / CAST({1024 ** power} AS DOUBLE)', 2)}) || ' {name}'"


add("i1_human_bytes", lambda spark, sf: V.flows(spark, sf).select(
    "flow_id", X.human_bytes(F.col("bytes") * F.col("bytes")).alias("text")), on_flows(
    f"SELECT flow_id, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN {_unit(1, 'KB')} "
    f"WHEN bytes < 1073741824 THEN {_unit(2, 'MB')} ELSE {_unit(3, 'GB')} END AS text "
    "FROM (SELECT flow_id, bytes * bytes AS bytes FROM flows)"))
add("i2_hour_label", lambda spark, sf: V.flows(spark, sf).groupBy(X.hour_label(F.hour("timestamp")).alias("label")).agg(
    F.count(F.lit(1)).alias("packets")), on_flows(
    f"SELECT lpad(CAST(hour({T}) AS VARCHAR), 2, '0') || ':00' AS label, count(*) AS packets FROM flows GROUP BY 1"))
add("i4_strip_markup", lambda spark, sf: V.table(spark, sf, "pages").select("page_id", X.strip_markup(F.col("html")).alias("text")),
    r"""SELECT page_id, replace(replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
    '<script[^>]*>.*?</script>', '', 'gis'), '<[^>]*on\w+\s*=[^>]*>', '', 'gi'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
    '''', '&#x27;'), 'javascript:', '', 'gi'), 'onerror=', ''), 'onload=', '') AS text FROM pages""")
add("i5_broad_class", lambda spark, sf: V.flows(spark, sf).groupBy("app_category").agg(F.count(F.lit(1)).alias("packets")).select(
    "app_category", F.coalesce(X.broad_class(F.col("app_category")), F.lit("others")).alias("class"), "packets"), on_flows(
    f"SELECT app_category, {BROAD} AS class, count(*) AS packets FROM flows GROUP BY 1"))
add("f9_model_severity", lambda spark, sf: V.table(spark, sf, "orders").select(
    "o_orderkey", X.model_severity(F.col("o_totalprice") % 100).alias("severity")),
    "SELECT o_orderkey, CASE WHEN s >= 85 THEN 'critical' WHEN s >= 70 THEN 'high' WHEN s >= 50 THEN 'medium' ELSE 'low' END AS severity "
    "FROM (SELECT o_orderkey, fmod(o_totalprice, CAST(100 AS DOUBLE)) AS s FROM orders)")

"""Ingest, canonicalisation and quality (family A)."""

from pyspark.sql import functions as F

from flowloom.catalog.base import add, on_activity, on_flows
from flowloom.functions import addresses as A
from flowloom.functions import scalars as X
from flowloom.operators import traffic as B
from flowloom.sources import canonical as N
from flowloom.sources import csvfiles, history
from flowloom.sources import sample_views as V

U, T = '"user"', '"timestamp"'
NOW = "2024-02-01 00:00:00"

_STAMP = f"CAST(strftime({T}, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP)"
RAW = f"""
raw AS (
  SELECT flow_id,
    CASE WHEN flow_id % 17 = 0 THEN TIMESTAMP '{NOW}'
         WHEN flow_id % 5 = 0 THEN make_timestamp(CAST('17' || lpad(CAST(flow_id % 100000000 AS VARCHAR), 8, '0') AS BIGINT) * 1000000 + 250000)
         WHEN flow_id % 7 = 0 THEN {_STAMP} - INTERVAL 2 HOUR
         ELSE {_STAMP} END AS ts,
    src_ip, CASE WHEN flow_id % 41 = 0 THEN 'unknown' ELSE dst_ip END AS dst_ip, src_port,
    CASE WHEN flow_id % 23 = 0 OR flow_id % 29 = 0 OR flow_id % 31 = 0 OR flow_id % 37 = 0 THEN 0 ELSE dst_port END AS dst_port,
    CASE WHEN flow_id % 43 = 0 THEN 'OTHER' ELSE protocol END AS protocol,
    CAST(CASE WHEN flow_id % 19 = 0 THEN 0 WHEN flow_id % 23 = 0 THEN 12 WHEN flow_id % 29 = 0 OR flow_id % 47 = 0 THEN 0
         ELSE bytes END AS BIGINT) AS bytes,
    app_category, CASE WHEN flow_id % 13 = 0 THEN '' ELSE {U} END AS u,
    CASE WHEN flow_id % 6 = 0 THEN 'host.example' ELSE '' END AS hostname,
    CASE WHEN flow_id % 10 = 0 THEN 'http://host.example/a' ELSE '' END AS url,
    CAST(flow_id % 99999 AS INTEGER) AS pid
  FROM flows)"""


def _ports(*ports: int) -> str:
    listed = ", ".join(map(str, ports))
    return f"(src_port IN ({listed}) OR dst_port IN ({listed}))"


CATEGORY = ("CASE " + " ".join([
    f"WHEN {_ports(53)} THEN 'DNS'", f"WHEN {_ports(1900)} THEN 'Device Discovery'",
    f"WHEN {_ports(5353, 5355)} THEN 'Local Name Resolution'", f"WHEN {_ports(67, 68, 546, 547)} THEN 'DHCP'",
    f"WHEN {_ports(123)} THEN 'NTP'", f"WHEN {_ports(80, 8080, 8000, 8888)} THEN 'Web'",
    f"WHEN protocol = 'UDP' AND {_ports(443, 784, 885, 993, 995)} THEN 'QUIC / Encrypted Web'",
    f"WHEN {_ports(443, 8443)} THEN 'Encrypted Web'", f"WHEN {_ports(22, 3389)} THEN 'Remote Access'",
    f"WHEN {_ports(25, 110, 143, 465, 587, 993, 995)} THEN 'Email'",
    f"WHEN {_ports(3478, 3479, 5349)} THEN 'Realtime Media'",
    "WHEN protocol IN ('ICMP', 'ICMPV6') THEN 'Network Control'"]) + " ELSE 'Other' END")


def _number(ip: str) -> str:
    part = f"CAST(nullif(split_part({ip}, '.', {{}}), '') AS BIGINT)".format
    return f"({part(1)} * 16777216 + {part(2)} * 65536 + {part(3)} * 256 + {part(4)})"


def _private(ip: str) -> str:
    """Registered private IPv4 ranges as plain number ranges."""
    ranges = [(0, 16777215), (167772160, 184549375), (2130706432, 2147483647), (2851995648, 2852061183),
              (2886729728, 2887778303), (3221225472, 3221225727), (3221225984, 3221226239), (3232235520, 3232301055),
              (3323068416, 3323199487), (3325256704, 3325256959), (3405803776, 3405804031), (4026531840, 4294967295)]
    tests = " OR ".join(f"{_number(ip)} BETWEEN {a} AND {b}" for a, b in ranges)
    return (f"CASE WHEN {ip} = 'unknown' THEN false ELSE ({tests}) AND {_number(ip)} NOT IN (3221225481, 3221225482) END")


USER = f"CASE WHEN {_private('src_ip')} THEN src_ip WHEN {_private('dst_ip')} THEN dst_ip WHEN src_ip <> 'unknown' THEN src_ip ELSE dst_ip END"


def _canonical(spark, sf):
    return N.canonicalise(V.raw_flows(spark, sf), NOW, ["flow_id"])


def _pick(*columns):
    return lambda spark, sf: _canonical(spark, sf).select("flow_id", *columns)


def on_raw(body: str, *ctes: str) -> str:
    return on_flows(body, RAW.strip(), *ctes)


_ORIGIN = {"tls_sni": "''", "dns_query": "''", "download_name": "''", "content_type": "''", "process_name": "''", "activity": "''"}
add("a3_canonicalise", _canonical, on_raw(
    f"SELECT flow_id, ts AS {T}, src_ip, dst_ip, src_port, dst_port, protocol, bytes, "
    f"CASE WHEN app_category <> '' THEN app_category ELSE {CATEGORY} END AS app_category, "
    f"CASE WHEN u <> '' THEN u ELSE {USER} END AS {U}, hostname, url, "
    + ", ".join(f"{v} AS {k}" for k, v in _ORIGIN.items())
    + ", pid AS process_id, CASE WHEN url <> '' THEN url ELSE hostname END AS activity_target FROM raw"))
add("a4_timestamps", _pick("timestamp"), on_raw(f"SELECT flow_id, ts AS {T} FROM raw"))
add("a5_ports", _pick("src_port", "dst_port"), on_raw("SELECT flow_id, src_port, dst_port FROM raw"))
add("a6_byte_counts", _pick("bytes"), on_raw("SELECT flow_id, bytes FROM raw"))
add("a7_private_addresses",
    lambda spark, sf: V.flows(spark, sf).select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).groupBy("ip").agg(
        F.count(F.lit(1)).alias("uses")).withColumn("private", A.is_private(F.col("ip"))),
    on_flows(f"SELECT ip, count(*) AS uses, {_private('ip')} AS private FROM (SELECT src_ip AS ip FROM flows UNION ALL "
             "SELECT dst_ip FROM flows) GROUP BY 1"))
add("a8_user_attribution",
    lambda spark, sf: V.flows(spark, sf).select("flow_id", A.attributed_user(F.col("src_ip"), F.col("dst_ip")).alias("owner"),
                                                A.attributed_user(F.col("dst_ip"), F.col("src_ip")).alias("peer")),
    on_flows(f"SELECT flow_id, {USER} AS owner, CASE WHEN {_private('dst_ip')} THEN dst_ip WHEN {_private('src_ip')} THEN src_ip "
             "ELSE dst_ip END AS peer FROM flows"))
add("a9_categorise",
    lambda spark, sf: V.flows(spark, sf).groupBy(
        X.categorise(F.col("protocol"), F.col("src_port"), F.col("dst_port")).alias("category")).agg(
        F.count(F.lit(1)).alias("packets")),
    on_flows(f"SELECT {CATEGORY} AS category, count(*) AS packets FROM flows GROUP BY 1"))
add("a10_activity_target", _pick("activity_target"), on_raw(
    "SELECT flow_id, CASE WHEN url <> '' THEN url ELSE hostname END AS activity_target FROM raw"))
add("a17_redact_url", lambda spark, sf: V.table(spark, sf, "pages").select("page_id", X.redact_url(F.col("url")).alias("shown")),
    r"""SELECT page_id, CASE WHEN q = '' THEN p ELSE p || '?' || CASE WHEN len(n) = 0 THEN '…' ELSE array_to_string(n[1:8], '&') END END AS shown
    FROM (SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS p, q,
      list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1)) AS n
    FROM (SELECT page_id, regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1) AS p, regexp_extract(u, '\?(.*)$', 1) AS q
    FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)))""")
add("a18_download_name",
    lambda spark, sf: V.activity_flows(spark, sf).where("download_name != ''").select("flow_id", X.download_name(
        F.concat(F.lit("attachment; FileName*=UTF-8''"), F.col("download_name"), F.lit("; size=1"))).alias("name")),
    on_activity("SELECT flow_id, download_name AS name FROM activity_flows WHERE download_name <> ''"))
add("a20_clean_text", lambda spark, sf: V.table(spark, sf, "documents").select(
    "doc_id", X.clean_text(F.col("text"), 240).alias("shown")),
    r"SELECT doc_id, substring(regexp_replace(replace(replace(text, chr(13), ''), chr(10), ''), '^\s+|\s+$', '', 'g'), 1, 240) AS shown FROM documents")


def _processes(spark, sf):
    return N.attribute_process(V.flows(spark, sf), V.connections(spark, sf)).select("flow_id", "process_name", "process_id")


_conn = """
conn AS (SELECT CASE m % 4 WHEN 3 THEN '192.0.2.1' WHEN 1 THEN dst_ip ELSE src_ip END AS lip,
  CASE WHEN m % 4 = 1 THEN dst_port ELSE src_port END AS lport,
  CASE m % 4 WHEN 2 THEN '' WHEN 1 THEN src_ip ELSE dst_ip END AS rip,
  CASE m % 4 WHEN 2 THEN 0 WHEN 1 THEN src_port ELSE dst_port END AS rport, protocol,
  CAST(m % 100000 + 1 AS INTEGER) AS pid, 'proc' || (m % 31) AS pname
  FROM (SELECT src_ip, src_port, dst_ip, dst_port, protocol, min(flow_id) AS m FROM flows GROUP BY ALL)),
exact AS (SELECT lip, lport, rip, rport, protocol, max({'a': pid, 'b': pname}) AS p FROM conn WHERE rip <> '' GROUP BY ALL),
loc AS (SELECT lip, lport, protocol, max({'a': pid, 'b': pname}) AS p FROM conn GROUP BY ALL)"""
add("a21_process_attribution", _processes, on_flows(
    "SELECT flow_id, coalesce(p.b, '') AS process_name, coalesce(p.a, 0) AS process_id FROM (SELECT f.flow_id, "
    "CASE WHEN f.protocol IN ('TCP', 'UDP') THEN coalesce(e1.p, e2.p, l1.p, l2.p) END AS p FROM flows f "
    "LEFT JOIN exact e1 ON (e1.lip, e1.lport, e1.rip, e1.rport, e1.protocol) = (f.src_ip, f.src_port, f.dst_ip, f.dst_port, f.protocol) "
    "LEFT JOIN exact e2 ON (e2.lip, e2.lport, e2.rip, e2.rport, e2.protocol) = (f.dst_ip, f.dst_port, f.src_ip, f.src_port, f.protocol) "
    "LEFT JOIN loc l1 ON (l1.lip, l1.lport, l1.protocol) = (f.src_ip, f.src_port, f.protocol) "
    "LEFT JOIN loc l2 ON (l2.lip, l2.lport, l2.protocol) = (f.dst_ip, f.dst_port, f.protocol))", _conn.strip()))
add("a23_quality_issues",
    lambda spark, sf: csvfiles.quality_issues(V.raw_flows(spark, sf).withColumnRenamed("frame.len", "bytes"), "flow_id"),
    on_flows("SELECT * FROM (SELECT flow_id, CASE WHEN flow_id % 19 = 0 THEN 'negative_bytes' WHEN flow_id % 23 = 0 OR flow_id % 29 = 0 "
             "OR flow_id % 47 = 0 THEN 'invalid_bytes' END AS rule, CASE WHEN flow_id % 19 = 0 THEN '-5' WHEN flow_id % 23 = 0 THEN '12.9' "
             "WHEN flow_id % 29 = 0 THEN '' ELSE 'n/a' END AS value FROM flows) WHERE rule IS NOT NULL"))


def _validity(spark, sf):
    """Addresses, ports and mail texts, spoiled for part of the rows."""
    flows = V.flows(spark, sf).selectExpr(
        "flow_id", "CASE WHEN flow_id % 7 = 0 THEN concat(src_ip, '.1') WHEN flow_id % 11 = 0 THEN replace(src_ip, '10.', '310.') ELSE src_ip END AS ip",
        "CASE WHEN flow_id % 5 = 0 THEN '70000' WHEN flow_id % 13 = 0 THEN 'x' ELSE cast(dst_port AS string) END AS port",
        "concat(user, CASE WHEN flow_id % 3 = 0 THEN '@example.org' ELSE '' END) AS mail")
    return flows.select("flow_id", A.is_ipv4(F.col("ip")).alias("ip_ok"), X.is_port(F.col("port")).alias("port_ok"),
                        X.is_email(F.col("mail")).alias("mail_ok"))


add("a24_validity", _validity, on_flows(
    f"SELECT flow_id, NOT (flow_id % 7 = 0 OR flow_id % 11 = 0) AS ip_ok, NOT (flow_id % 5 = 0 OR flow_id % 13 = 0) AS port_ok, "
    f"flow_id % 3 = 0 AND {U} <> '' AS mail_ok FROM flows"))
add("a25_safe_file_name", lambda spark, sf: V.activity_flows(spark, sf).select(
    "flow_id", X.safe_file_name(F.col("download_name")).alias("name")),
    on_activity("SELECT flow_id, CASE WHEN download_name = '' THEN 'unnamed' ELSE replace(replace(replace(download_name, ' ', '_'), '(', '_'), "
                "')', '_') END AS name FROM activity_flows"))
add("a27_time_parts", lambda spark, sf: B.with_time_parts(V.flows(spark, sf)).select("flow_id", "hour", "date"), on_flows(
    f"SELECT flow_id, CAST(hour({T}) AS INTEGER) AS hour, CAST({T} AS DATE) AS date FROM flows"))
add("a32_history_page", lambda spark, sf: history.list_reports(V.reports(spark, sf), 20, 40),
    "SELECT o_orderkey AS id, 'report-' || o_orderkey || '.csv' AS filename, o_orderdate AS created_at FROM orders "
    "ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
add("a31_history_lookup",
    lambda spark, sf: history.find_report(V.reports(spark, sf), 17, "status string, users bigint").select(
        "id", "filename", "created_at", "data.status", "data.users"),
    "SELECT o_orderkey AS id, 'report-' || o_orderkey || '.csv' AS filename, o_orderdate AS created_at, o_orderstatus AS status, "
    "o_custkey AS users FROM orders WHERE o_orderkey = 17")


def _retention(spark, sf):
    from datetime import datetime
    return history.retained(V.reports(spark, sf), datetime(1999, 1, 1), 365).select("id", "filename", "created_at")


add("a33_history_retention", _retention,
    "SELECT o_orderkey AS id, 'report-' || o_orderkey || '.csv' AS filename, o_orderdate AS created_at FROM orders "
    "WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")

"""Security rules, block list and summaries (family E)."""

from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.catalog.base import add, half_up, on_flows, over_flows, seconds
from flowloom.operators import rules as R
from flowloom.sources import sample_views as V

U, T = '"user"', '"timestamp"'
PAIR = f"{U} || ' / ' || src_ip"
MIB = 1024 * 1024


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _human(expr: str) -> str:
    number = f"CAST({expr} AS DOUBLE)"
    arms = []
    for power, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        value = half_up(f"{number} / CAST({1024 ** power} AS DOUBLE)", 2)
        arms.append(f"WHEN {number} < {1024 ** (power + 1)} THEN printf('%.2f', {value}) || ' {unit}'")
    last = half_up(f"{number} / CAST({1024 ** 5} AS DOUBLE)", 2)
    return f"(CASE {' '.join(arms)} ELSE printf('%.2f', {last}) || ' PB' END)"


def _one(expr: str) -> str:
    return f"printf('%.1f', {half_up(expr, 1)})"


def _alert(kind: str, source: str, score: str, entity: str, evidence: str, target_type: str,
           title: str | None = None, key: str = "''") -> str:
    target = "src_ip" if target_type == "src_ip" else U
    title = title or f"'{kind}'"
    return (f"SELECT {R.RULES.index(kind) + 1} AS rule_no, '{kind}' AS type, CAST({score} AS INTEGER) AS score, "
            f"{title} AS title, {entity} AS entity, {evidence} AS evidence, {_quote(R.ACTIONS[kind])} AS suggested_action, "
            f"'{target_type}' AS target_type, {target} AS target, "
            f"'{kind}' || '|' || {entity} || '|' || {title} || '|' || {key} AS alert_key FROM ({source})")


_sensitive = ", ".join(map(str, S.SENSITIVE_PORTS))
_service = "(CASE dst_port " + " ".join(f"WHEN {p} THEN '{n}'" for p, n in S.SENSITIVE_PORTS.items()) + " END)"
_exfil = ", ".join(map(str, S.EXFILTRATION_PORTS))

SQL = {}
SQL["reconnaissance"] = _alert(
    "reconnaissance",
    f"SELECT {U}, src_ip, count(*) AS n, count(DISTINCT dst_port) AS p, count(DISTINCT dst_ip) AS t FROM flows GROUP BY 1, 2 "
    "HAVING p >= 8 OR t >= 10 OR (n >= 40 AND p >= 5)",
    "least(95, 45 + 4 * p + 3 * t)", PAIR, "'ports=' || p || '; targets=' || t || '; rows=' || n", "src_ip")
SQL["sensitive_service"] = _alert(
    "sensitive_service",
    f"SELECT {U}, src_ip, dst_port, count(*) AS h, count(DISTINCT dst_ip) AS t FROM flows WHERE dst_port IN ({_sensitive}) "
    "GROUP BY 1, 2, 3 HAVING h >= 3 OR t >= 2",
    "least(90, 38 + 5 * h + 8 * t)", PAIR, "'hits=' || h || '; targets=' || t", "src_ip",
    f"'sensitive_service ' || {_service} || '/' || dst_port")
SQL["traffic_anomaly"] = _alert(
    "traffic_anomaly",
    f"SELECT * FROM (SELECT *, CAST(b AS DOUBLE) / CAST((SELECT greatest(floor(median(b)), 1) FROM ub) AS DOUBLE) AS ratio "
    f"FROM (SELECT * FROM ub ORDER BY b DESC, {U} LIMIT 5)) WHERE ratio >= 5 AND b >= {10 * MIB} AND (SELECT count(*) FROM ub) >= 2",
    "least(85, floor(35 + ratio * 6))", U, f"'bytes=' || {_human('b')} || '; times_median=' || {_one('ratio')}", "user")
SQL["off_hours_activity"] = _alert(
    "off_hours_activity",
    f"SELECT {U}, count(*) AS n, sum(bytes) AS b FROM flows WHERE hour({T}) BETWEEN 0 AND 5 GROUP BY 1 "
    f"HAVING n >= 10 OR b >= {5 * MIB}",
    "least(78, 36 + 2 * n)", U, f"'rows=' || n || '; bytes=' || {_human('b')}", "user")


def _text_rule(kind: str) -> str:
    terms, score = R.TEXT_RULES[kind]
    listed = ", ".join(f"CASE WHEN contains(txt, {_quote(t)}) THEN {_quote(t)} END" for t in terms)
    return _alert(kind, "SELECT * FROM (SELECT *, list_filter([" + listed + "], lambda x: x IS NOT NULL) AS found FROM txt_flows) "
                  "WHERE len(found) > 0", str(score), PAIR, "'terms=' || array_to_string(found[1:5], ', ')", "src_ip",
                  key="CAST(flow_id AS VARCHAR)")


for _kind in R.TEXT_RULES:
    SQL[_kind] = _text_rule(_kind)
SQL["dns_tunneling"] = _alert(
    "dns_tunneling",
    f"SELECT *, CAST(b AS DOUBLE) / CAST(n AS DOUBLE) AS m FROM (SELECT {U}, count(*) AS n, sum(bytes) AS b FROM flows "
    "WHERE dst_port = 53 GROUP BY 1) WHERE n > 100 AND m > 100",
    "least(95, 50 + least(n // 10, 30) + least(floor(m / 10), 15))", U,
    f"'queries=' || n || '; bytes=' || {_human('b')} || '; mean=' || {_one('m')}", "user")
SQL["data_exfiltration"] = _alert(
    "data_exfiltration",
    f"SELECT {U}, dst_port, sum(bytes) AS b, count(DISTINCT dst_ip) AS t FROM flows WHERE dst_port IN ({_exfil}) "
    f"GROUP BY 1, 2 HAVING b >= {10 * MIB}",
    f"least(92, 45 + least(b // {5 * MIB}, 35) + 3 * t)", U,
    f"'port=' || dst_port || '; bytes=' || {_human('b')} || '; targets=' || t", "user",
    "'data_exfiltration port ' || dst_port")
SQL["port_sweep"] = _alert(
    "port_sweep",
    f"SELECT *, CAST(n AS DOUBLE) / greatest(span, CAST(1 AS DOUBLE)) AS rate FROM (SELECT {U}, src_ip, dst_port, count(*) AS n, "
    f"count(DISTINCT dst_ip) AS t, {seconds(f'min({T})', f'max({T})')} AS span FROM flows GROUP BY 1, 2, 3) "
    "WHERE t >= 5 AND n >= 10",
    "least(88, 40 + least(3 * t, 25) + least(floor(rate * 5), 15))", PAIR,
    f"'port=' || dst_port || '; targets=' || t || '; attempts=' || n || '; per_second=' || {_one('rate')}", "src_ip",
    "'port_sweep port ' || dst_port")
SQL["beaconing"] = _alert(
    "beaconing",
    f"SELECT {U}, src_ip, dst_ip, n, avg(gap) AS m, {half_up('stddev_samp(gap)', 6)} AS s FROM (SELECT {U}, src_ip, dst_ip, "
    f"CAST(us - lag(us) OVER w AS DOUBLE) / CAST(1000000 AS DOUBLE) AS gap, count(*) OVER (PARTITION BY {U}, src_ip, dst_ip) AS n "
    f"FROM (SELECT *, epoch_us({T}) AS us FROM flows) WINDOW w AS (PARTITION BY {U}, src_ip, dst_ip ORDER BY us)) "
    "WHERE gap > 0 GROUP BY 1, 2, 3, 4 HAVING n >= 5 AND count(*) >= 4 AND m >= 10 AND s < m * 0.3",
    "least(85, 40 + least(floor(30 / greatest(m, 1)), 20) + greatest(0, 25 - floor(s)))", PAIR,
    f"'target=' || dst_ip || '; rows=' || n || '; mean_gap=' || {_one('m')} || '; std_gap=' || {_one('s')}", "src_ip",
    key="dst_ip")

CTES = [f"ub AS (SELECT {U}, sum(bytes) AS b FROM flows GROUP BY 1)",
        f"txt_flows AS (SELECT *, lower(payload || ' ' || app_category || ' ' || protocol || ' ' || {U}) AS txt FROM flows)"]
SEVERITY = ("CASE WHEN score >= 90 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' "
            "ELSE 'low' END AS severity")


def _rules(*kinds: str) -> str:
    return " UNION ALL ".join(SQL[k] for k in kinds)


def _with_severity(*kinds: str) -> str:
    return on_flows(f"SELECT *, {SEVERITY} FROM ({_rules(*kinds)})", *CTES)


ALL_ALERTS = [*CTES, f"alerts AS (SELECT *, {SEVERITY} FROM ({_rules(*R.RULES)}))"]

add("e1_reconnaissance", over_flows(R.reconnaissance), _with_severity("reconnaissance"))
add("e2_sensitive_service", over_flows(R.sensitive_service), _with_severity("sensitive_service"))
add("e3_volume_anomaly", over_flows(R.traffic_anomaly), _with_severity("traffic_anomaly"))
add("e4_off_hours", over_flows(R.off_hours), _with_severity("off_hours_activity"))
add("e5_text_indicators", over_flows(R.text_indicators), _with_severity(*R.TEXT_RULES))
add("e6_dns_tunneling", over_flows(R.dns_tunneling), _with_severity("dns_tunneling"))
add("e7_exfiltration", over_flows(R.data_exfiltration), _with_severity("data_exfiltration"))
add("e8_port_sweep", over_flows(R.port_sweep), _with_severity("port_sweep"))
add("e9_beaconing", over_flows(R.beaconing), _with_severity("beaconing"))
add("e10_alert_rows", lambda spark, sf: R.with_alert_ids(R.all_alerts(V.flows(spark, sf))), on_flows(
    "SELECT *, 'SEC-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS id "
    "FROM (SELECT *, row_number() OVER (ORDER BY rule_no, md5(alert_key)) AS n FROM alerts)", *ALL_ALERTS)
    .replace("SELECT *, 'SEC-'", "SELECT * EXCLUDE (n), 'SEC-'"))
_levels = {"beaconing": "critical", "off_hours_activity": "low"}
add("e11_severity_overrides",
    lambda spark, sf: R.with_severity_overrides(R.all_alerts(V.flows(spark, sf)), _levels)
    .groupBy("type", "severity").agg(F.count(F.lit(1)).alias("alerts")),
    on_flows("SELECT type, CASE type WHEN 'beaconing' THEN 'critical' WHEN 'off_hours_activity' THEN 'low' ELSE severity END "
             "AS severity, count(*) AS alerts FROM alerts GROUP BY 1, 2", *ALL_ALERTS))
BLOCK = ("SELECT target_type, target, max(score) AS max_score, string_agg(DISTINCT title, ', ' ORDER BY title) AS reasons, "
          "CASE WHEN max(score) >= 85 THEN 'quarantine' WHEN max(score) >= 75 THEN 'rate_limit' ELSE 'step_up_auth' END AS action, "
          "CASE WHEN max(score) >= 85 THEN 30 WHEN max(score) >= 75 THEN 15 ELSE 10 END AS ttl_minutes "
          "FROM alerts WHERE score >= 70 GROUP BY 1, 2")
add("e12_block_list", lambda spark, sf: R.block_list(R.all_alerts(V.flows(spark, sf))), on_flows(BLOCK, *ALL_ALERTS))
add("e13_risk_summary", lambda spark, sf: R.risk_summary(R.all_alerts(V.flows(spark, sf))), on_flows(
    "SELECT *, CASE WHEN risk_score >= 90 THEN 'critical' WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 40 THEN 'medium' "
    "ELSE 'low' END AS risk_level FROM (SELECT least(coalesce(max(score), 0), 100) AS risk_score, count(*) AS total_alerts, "
    + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}_alerts" for s in ("critical", "high", "medium", "low"))
    + " FROM alerts)", *ALL_ALERTS))


def _complete_report(spark, sf):
    """Alerts, block list and summary in one long frame."""
    frames = R.report(V.flows(spark, sf))
    parts = [f.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("body")) for name, f in frames.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


add("e14_complete_report", _complete_report)
_names = " ".join(f"WHEN {p} THEN '{n}'" for p, n in S.ATTACK_SERVICE_NAMES.items())


def _attack_sources(spark, sf):
    flows = V.flows(spark, sf)
    return R.attack_sources(flows, R.block_list(R.all_alerts(flows)))


add("e15_attack_sources", _attack_sources, on_flows(
    f"SELECT (SELECT count(DISTINCT src_ip) FROM flows) AS sources, p AS top_port, CASE p {_names} ELSE 'TCP/UDP' END AS service, "
    f"(SELECT count(*) FROM ({BLOCK})) AS blocked FROM (SELECT dst_port AS p, count(*) AS n FROM flows GROUP BY 1 "
    "ORDER BY n DESC, p LIMIT 1)", *ALL_ALERTS))


def _text_table(name: str, key: str, column: str) -> None:
    arms = []
    for kind, (terms, _) in R.TEXT_RULES.items():
        listed = ", ".join(f"CASE WHEN contains(txt, {_quote(t)}) THEN {_quote(t)} END" for t in terms)
        arms.append(f"SELECT {key}, '{kind}' AS rule, array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL)[1:5], ', ') "
                    f"AS terms FROM (SELECT {key}, lower({column}) AS txt FROM {name})")
    add(f"e5_{name}_{column}", lambda spark, sf: R.text_rule_hits(V.table(spark, sf, name), key, F.col(column)),
        "SELECT * FROM (" + " UNION ALL ".join(arms) + ") WHERE terms <> ''")


_text_table("documents", "doc_id", "text")
_text_table("pages", "page_id", "html")
_text_table("pages", "page_id", "url")
_text_table("conversations", "conv_id", "text")

def _a26(spark, sf):
    flows = V.flows(spark, sf)
    dirty = flows.selectExpr(
        "flow_id", "substring(cast(timestamp AS string), 1, 19) AS timestamp",
        "CASE WHEN flow_id % 11 = 0 THEN 'bad' ELSE cast(bytes AS string) END AS bytes",
        "CASE WHEN flow_id % 9 = 0 THEN NULL ELSE cast(dst_port AS string) END AS dst_port",
        "CASE WHEN flow_id % 8 = 0 THEN NULL ELSE user END AS user")
    return R.clean_flows(dirty)


add("a26_clean_flows", _a26, on_flows(
    f"SELECT flow_id, date_trunc('second', {T}) AS timestamp, CASE WHEN flow_id % 11 = 0 THEN 0 ELSE bytes END AS bytes, "
    f"CASE WHEN flow_id % 9 = 0 THEN 0 ELSE dst_port END AS dst_port, CASE WHEN flow_id % 8 = 0 THEN 'unknown' ELSE {U} END AS {U}, "
    f"CAST(hour({T}) AS INTEGER) AS hour FROM flows").replace("date_trunc('second', " + T + ")", f"CAST(date_trunc('second', {T}) AS TIMESTAMP)"))


def _reputation(spark, sf):
    """Reputation feed drawn from the flows themselves: heavily used public targets."""
    flows = V.flows(spark, sf)
    feed = flows.groupBy(F.col("dst_ip").alias("ip")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select(
        "ip", F.lit("listed").alias("reputation"), F.lit(50).alias("score"))
    return R.address_reputation(flows, feed)


add("i3_address_reputation", _reputation, on_flows(
    "SELECT dst_ip AS ip, count(*) AS packets, CASE WHEN count(*) >= 20 THEN 'listed' WHEN dst_ip LIKE '10.%' OR dst_ip LIKE '192.168.%' "
    "OR dst_ip LIKE '172.16.%' THEN 'clean' ELSE 'unknown' END AS reputation, CASE WHEN count(*) >= 20 THEN 50 ELSE 0 END AS score "
    "FROM flows GROUP BY 1"))

"""Composed reports (E14, H10, H11)."""

from pyspark.sql import functions as F

from flowloom.catalog.anomalies import FEATURES, SCORES, feature_scores
from flowloom.catalog.base import add, big, on_activity, on_flows
from flowloom.catalog.security import ALL_ALERTS, BLOCK
from flowloom.operators import rules as R
from flowloom.operators import traffic as B
from flowloom.operators.anomaly import ensemble as M
from flowloom.plans import jobs
from flowloom.session import durable
from flowloom.sources import sample_views as V


def _dashboard(spark, sf):
    """The dashboard's tables in one long frame."""
    flows = V.activity_flows(spark, sf)
    alerts = durable(R.all_alerts(flows))
    parts = {"total_traffic": B.totals(flows), "user_ranking": B.top_users(flows, 15), "app_category": B.category_bytes(flows),
             "active_hours": B.active_hours(flows), "attack_sources": R.attack_sources(flows, R.block_list(alerts)),
             "risk_summary": R.risk_summary(alerts), "activity_summary": B.activity_summary(flows)}
    report = M.model_report(flows, "isolation_forest")
    parts |= {"outlier_summary": report["summary"], "outliers": report["anomalies"]}
    out = None
    for name, frame in parts.items():
        part = frame.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("body"))
        out = part if out is None else out.unionByName(part)
    return out


add("h10_overall_summary", lambda spark, sf: jobs.summary_query(V.flows(spark, sf)))
add("h11_dashboard", _dashboard)


def _rows(part, frame, key, name, amount):
    return frame.select(F.lit(part).alias("part"), F.expr(key).cast("string").alias("key"), F.expr(name).cast("string").alias("name"),
                        F.expr(amount).cast("double").alias("amount"))


def _union(parts):
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _measures(part, frame):
    """One row per numeric column of a one-row frame."""
    numeric = [c for c, kind in frame.dtypes if kind in ("int", "bigint", "double")]
    return frame.select(F.lit(part).alias("part"), F.lit("").alias("key"), F.inline(F.array(*(
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("amount")) for c in numeric))))


def _report_rows(spark, sf):
    alerts = durable(R.all_alerts(V.flows(spark, sf)))
    return _union([_rows("alert", alerts, "alert_key", "type || '|' || severity || '|' || evidence", "score"),
                   _rows("block", R.block_list(alerts), "target_type || '|' || target", "action || '|' || ttl_minutes || '|' || reasons", "max_score"),
                   _measures("summary", R.risk_summary(alerts))])


_dbl = "CAST({} AS DOUBLE)".format
_RISK = ["SELECT 'summary', '', 'risk_score', CAST(least(coalesce(max(score), 0), 100) AS DOUBLE) FROM alerts",
         "SELECT 'summary', '', 'total_alerts', CAST(count(*) AS DOUBLE) FROM alerts",
         *(f"SELECT 'summary', '', '{s}_alerts', CAST(count(*) FILTER (severity = '{s}') AS DOUBLE) FROM alerts" for s in ("critical", "high", "medium", "low"))]
add("e14_report_rows", _report_rows, on_flows(" UNION ALL ".join([
    "SELECT 'alert' AS part, alert_key AS key, type || '|' || severity || '|' || evidence AS name, CAST(score AS DOUBLE) AS amount FROM alerts",
    f"SELECT 'block', target_type || '|' || target, action || '|' || ttl_minutes || '|' || reasons, CAST(max_score AS DOUBLE) FROM ({BLOCK})", *_RISK]), *ALL_ALERTS))


def _summary_rows(spark, sf):
    """The overall summary, its anomalies counted by a score that SQL has too."""
    flows = V.flows(spark, sf)
    return jobs.overall_summary(flows, durable(R.all_alerts(flows)), feature_scores(spark, sf)["total_bytes"])


_TOTAL = {"total_bytes": "sum(bytes)", "total_packets": "count(*)", "unique_users": 'count(DISTINCT "user")',
          "src_plus_dst_ips": "count(DISTINCT src_ip) + count(DISTINCT dst_ip)"}
_HOUR = """printf('%02d:00', hour("timestamp"))"""
add("h10_summary_rows", _summary_rows, on_flows(" UNION ALL ".join([
    *(f"SELECT 'total' AS section, '{name}' AS name, {big(sql)} AS amount FROM flows" for name, sql in _TOTAL.items()),
    f"""(SELECT 'user', "user", {big('sum(bytes)')} FROM flows GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)""",
    f"SELECT 'category', app_category, {big('sum(bytes)')} FROM flows GROUP BY 2",
    f"SELECT 'hour', {_HOUR}, {big('sum(bytes)')} FROM flows GROUP BY 2",
    "SELECT 'count', 'alerts', count(*) FROM alerts",
    "SELECT 'count', 'anomalies', count(*) FILTER (flag) FROM sc WHERE model = 'total_bytes'"]), *ALL_ALERTS, FEATURES.strip(), SCORES.strip()))


def _dashboard_rows(spark, sf):
    """The dashboard's tables in one typed frame, but for the outlier model."""
    flows = V.flows(spark, sf)
    alerts = durable(R.all_alerts(flows))
    return _union([
        _measures("total_traffic", B.totals(flows)), _rows("user_ranking", B.top_users(flows, 15), "user", "''", "bytes"),
        _rows("app_category", B.category_bytes(flows), "app_category", "''", "bytes"),
        *(_rows("active_hours", B.active_hours(flows), "hour", f"'{c}'", c) for c in ("active_users", "total_bytes", "packet_count")),
        _rows("attack_sources", R.attack_sources(flows, R.block_list(alerts)), "top_port", "blocked", "sources"),
        _measures("summary", R.risk_summary(alerts)), _rows("activity", B.activity_summary(V.activity_flows(spark, sf)), "section", "name", "amount")])


def _text_counts(section, column):
    return (f"(SELECT 'activity', '{section}', trim({column}), CAST(count(*) AS DOUBLE) FROM activity_flows WHERE trim({column}) <> '' "
            "GROUP BY 3 ORDER BY 4 DESC, 3 LIMIT 20)")


add("h11_dashboard_rows", _dashboard_rows, on_activity(" UNION ALL ".join([
    *(f"SELECT 'total_traffic' AS part, '' AS key, '{name}' AS name, {_dbl(sql)} AS amount FROM flows" for name, sql in _TOTAL.items()),
    f"""(SELECT 'user_ranking', "user", '', {_dbl('sum(bytes)')} FROM flows GROUP BY 2 ORDER BY 4 DESC, 2 LIMIT 15)""",
    f"SELECT 'app_category', app_category, '', {_dbl('sum(bytes)')} FROM flows GROUP BY 2",
    *(f"SELECT 'active_hours', {_HOUR}, '{name}', {_dbl(sql)} FROM flows GROUP BY 2" for name, sql in (
        ("active_users", 'count(DISTINCT "user")'), ("total_bytes", "sum(bytes)"), ("packet_count", "count(*)"))),
    "(SELECT 'attack_sources', CAST(dst_port AS VARCHAR), CAST((SELECT count(*) FROM (" + BLOCK + ")) AS VARCHAR), "
    "(SELECT CAST(count(DISTINCT src_ip) AS DOUBLE) FROM flows) FROM flows GROUP BY dst_port ORDER BY count(*) DESC, dst_port LIMIT 1)", *_RISK,
    _text_counts("host", "hostname"), _text_counts("process", "process_name"), _text_counts("activity", "activity"),
    "(SELECT 'activity', 'download', download_name || '|' || CASE WHEN hostname <> '' THEN hostname ELSE src_ip END, CAST(bytes AS DOUBLE) FROM activity_flows "
    """WHERE trim(download_name) <> '' ORDER BY "timestamp" DESC, flow_id DESC LIMIT 20)"""]), *ALL_ALERTS))

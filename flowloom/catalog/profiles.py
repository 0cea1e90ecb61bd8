"""Profile metrics (family C) and behaviour tags (family D)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.catalog.base import add, big, half_up, on_flows, over_flows, pct, seconds
from flowloom.operators import profile as C
from flowloom.operators import tags as D
from flowloom.sources import sample_views as V

U, T = '"user"', '"timestamp"'
HOUR = f"CAST(hour({T}) AS INTEGER)"


def _like(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(app_category), '{w}')" for w in words)


BROAD = "CASE " + " ".join(f"WHEN {_like(words)} THEN '{name}'" for name, words in S.BROAD_CLASSES.items()) + " ELSE 'others' END"
CLASSES = [*S.BROAD_CLASSES, "others"]
SHARES = [f"uc AS (SELECT {U}, {BROAD} AS category, sum(bytes) AS b FROM flows GROUP BY 1, 2)",
          f"ut AS (SELECT {U}, sum(b) AS total FROM uc GROUP BY 1)",
          f"cs AS (SELECT {U}, category, {pct('b', 'total')} AS pct FROM uc JOIN ut USING ({U}) WHERE b > 0)"]

add("c1_users", over_flows(C.users), on_flows(f"SELECT DISTINCT {U} FROM flows"))
add("c2_category_share", over_flows(C.category_share), on_flows("SELECT * FROM cs", *SHARES))
add("c3_hourly_activity", over_flows(C.hourly_activity), on_flows(
    f'SELECT {U}, {HOUR} AS hour, {big("sum(bytes)")} AS bytes, count(*) AS "count" FROM flows GROUP BY 1, 2'))
add("c4_protocol_share", over_flows(C.protocol_share), on_flows(
    f"SELECT {U}, protocol, {pct('b', 'sum(b) OVER (PARTITION BY ' + U + ')')} AS pct FROM "
    f"(SELECT {U}, protocol, sum(bytes) AS b FROM flows GROUP BY 1, 2)"))
_tls = "count(*) FILTER (WHERE dst_port = 443)"
add("c5_encrypted_share", over_flows(C.encrypted_share), on_flows(
    f"SELECT {U}, {_tls} AS encrypted_packets, count(*) - {_tls} AS unencrypted_packets, "
    f"{pct(_tls, 'count(*)')} AS encryption_ratio FROM flows GROUP BY 1"))
_hours = f"({seconds(f'min({T})', f'max({T})')} / CAST(3600 AS DOUBLE))"
add("c6_connection_rate", over_flows(C.connection_rate), on_flows(
    f"SELECT {U}, CASE WHEN h > 0 THEN {half_up('CAST(n AS DOUBLE) / h', 2)} ELSE CAST(0 AS DOUBLE) END AS connections_per_hour, "
    f"CASE WHEN h > 0 THEN {half_up('h', 2)} ELSE CAST(0 AS DOUBLE) END AS total_hours, n AS total_connections "
    f"FROM (SELECT {U}, count(*) AS n, {_hours} AS h FROM flows GROUP BY 1)"))
add("c7_peak_bandwidth", over_flows(C.peak_bandwidth), on_flows(
    f"SELECT {U}, {half_up('CAST(b AS DOUBLE) / CAST(3600 AS DOUBLE)', 2)} AS peak_bytes_per_second, h AS peak_hour, "
    f"{big('b')} AS total_peak_bytes FROM (SELECT *, row_number() OVER (PARTITION BY {U} ORDER BY b DESC, h) AS r FROM "
    f"(SELECT {U}, {HOUR} AS h, sum(bytes) AS b FROM flows GROUP BY 1, 2)) WHERE r = 1"))
add("c8_protocol_diversity",
    lambda spark, sf: over_flows(C.protocol_diversity)(spark, sf).selectExpr(
        "user", "cast(unique_protocols AS bigint) AS unique_protocols", "array_join(protocols, ',') AS protocols"),
    on_flows(f"SELECT {U}, count(DISTINCT protocol) AS unique_protocols, "
             f"string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS protocols FROM flows GROUP BY 1"))
_watched = ", ".join(map(str, S.WATCHED_PORTS))
add("c9_watched_ports", over_flows(C.watched_ports), on_flows(
    f"SELECT {U}, dst_port AS port, count(*) AS hits FROM flows WHERE dst_port IN ({_watched}) GROUP BY 1, 2"))
add("c10_dns_stats", over_flows(C.dns_stats), on_flows(
    f"SELECT {U}, count(*) FILTER (WHERE dst_port = 53) AS dns_queries, "
    f"{big('coalesce(sum(bytes) FILTER (WHERE dst_port = 53), 0)')} AS dns_bytes FROM flows GROUP BY 1"))
add("c11_daily_bytes", over_flows(C.daily_bytes), on_flows(
    f"SELECT {U}, CAST({T} AS DATE) AS date, {big('sum(bytes)')} AS bytes FROM flows GROUP BY 1, 2"))
add("c12_download_upload", over_flows(C.download_upload), on_flows(
    f"SELECT {U}, {big('d')} AS download_bytes, {big('u')} AS upload_bytes, "
    f"CASE WHEN u > 0 THEN {half_up('CAST(d AS DOUBLE) / CAST(u AS DOUBLE)', 2)} END AS ratio FROM "
    f"(SELECT {U}, coalesce(sum(bytes) FILTER (WHERE dst_port >= 1024), 0) AS d, "
    f"coalesce(sum(bytes) FILTER (WHERE dst_port < 1024), 0) AS u FROM flows GROUP BY 1)"))
add("c13_connection_count", over_flows(C.connection_count), on_flows(
    f"SELECT {U}, count(*) AS connections FROM flows GROUP BY 1"))
VARIANCE = [f"uh AS (SELECT {U}, {HOUR} AS h, CAST(sum(bytes) AS HUGEINT) AS b FROM flows GROUP BY 1, 2)",
            f"uv AS (SELECT {U}, CAST(24 * sum(b * b) - sum(b) * sum(b) AS DOUBLE) / CAST(576 AS DOUBLE) AS variance, "
            f"count(*) AS hours FROM uh GROUP BY 1)"]
add("c14_variance_baseline",
    lambda spark, sf: over_flows(C.variance_baseline)(spark, sf).selectExpr("floor(median_variance) AS median_variance"),
    on_flows("SELECT CAST(floor(median(variance)) AS BIGINT) AS median_variance FROM uv", *VARIANCE))
add("c15_population_stats",
    lambda spark, sf: over_flows(C.population_stats)(spark, sf).selectExpr(
        "floor(mean * 100D + 0.5D) / 100D AS mean", "floor(std * 100D + 0.5D) / 100D AS std"),
    on_flows(f"SELECT {half_up('avg(CAST(b AS DOUBLE))', 2)} AS mean, {half_up('stddev_samp(CAST(b AS DOUBLE))', 2)} AS std "
             f"FROM (SELECT {U}, sum(bytes) AS b FROM flows GROUP BY 1)"))

# --- tags -------------------------------------------------------------------------------
_num = "CAST({} AS DOUBLE)".format


def _part(test: str) -> str:
    return f"coalesce(sum(bytes) FILTER (WHERE {test}), 0)"


PER_USER = f"""
pu AS (SELECT {U}, count(*) AS n, sum(bytes) AS bytes,
  bool_and(regexp_matches(src_ip, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)')) AS internal,
  {_part("dst_port = 443 AND protocol = 'UDP'")} AS vpn, count(*) FILTER (WHERE dst_port = 53) AS dns,
  {_part("hour(" + T + ") IN (22, 23, 0, 1, 2)")} AS late, {_part("hour(" + T + ") BETWEEN 6 AND 9")} AS early,
  {_part("isodow(" + T + ") > 5")} AS weekend, {_part("isodow(" + T + ") <= 5")} AS weekday,
  count(*) FILTER (WHERE isodow({T}) <= 5) AS weekday_rows,
  count(*) FILTER (WHERE dst_port IN ({_watched})) AS watched,
  count(DISTINCT CASE WHEN dst_port IN ({_watched}) THEN dst_port END) AS watched_ports
  FROM flows GROUP BY 1)"""
PEAK = (f"pk AS (SELECT {U}, h AS peak FROM (SELECT *, row_number() OVER (PARTITION BY {U} ORDER BY b DESC, h) AS r "
        f"FROM uh) WHERE r = 1)")
WIDE = "cw AS (SELECT " + U + ", max(pct) AS top, " + ", ".join(
    f"coalesce(max(pct) FILTER (WHERE category = '{c}'), 0) AS {c}" for c in CLASSES) + " FROM cs GROUP BY 1)"
ALL = ("f AS (SELECT pu.*, uv.variance, uv.hours, pk.peak, "
       + ", ".join(f"coalesce(cw.{c}, 0) AS p_{c}" for c in CLASSES)
       + ", coalesce(cw.top, 0) AS top_share, (SELECT median(variance) FROM uv) AS mv, "
       "(SELECT avg(CAST(bytes AS DOUBLE)) FROM pu) AS pm, (SELECT stddev_samp(CAST(bytes AS DOUBLE)) FROM pu) AS ps "
       f"FROM pu LEFT JOIN uv USING ({U}) LEFT JOIN pk USING ({U}) LEFT JOIN cw USING ({U}))")
FEATURES = [PER_USER.strip(), *VARIANCE, PEAK, *SHARES, WIDE, ALL]


def _of_bytes(part: str) -> str:
    return f"(CASE WHEN bytes > 0 THEN {_num(part)} / {_num('bytes')} * {_num('100')} ELSE 0 END)"


TAG_SQL = {
    "heavy_collector": "n > 100",
    "internal_user": "internal",
    "external_user": "NOT internal",
    "vpn_user": f"{_of_bytes('vpn')} > 20",
    "bulk_downloader": f"{_num('bytes')} / {_num('n')} > 1000",
    "light_user": "bytes < 10000",
    "heavy_traffic": f"ps > 0 AND {_num('bytes')} > pm + ps * {_num('2')}",
    "gamer": "p_game > 30",
    "video_heavy": "p_video > 40",
    "balanced": "top_share > 0 AND top_share < 40",
    "social": "p_social + p_chat > 30",
    "learner": "p_edu > 20",
    "technical": "watched > 20",
    "night_owl": f"{_of_bytes('late')} > 40",
    "early_riser": f"{_of_bytes('early')} > 30",
    "regular": f"hours > 1 AND mv > 0 AND variance < mv * {_num('0.5')}",
    "volatile": f"hours > 1 AND mv > 0 AND variance > mv * {_num('1.5')}",
    "possible_scan": "watched_ports >= 3",
    "suspicious_dns": "dns > 50",
    "abnormal_hours": f"{_of_bytes('late')} > 60",
    "weekend_active": f"{_num('weekend')} > {_num('weekday')} / {_num('greatest(weekday_rows, 1)')}",
    "morning_active": "peak BETWEEN 6 AND 11",
    "afternoon_active": "peak BETWEEN 12 AND 17",
}


def _tags(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT {U}, '{n}' AS tag FROM f WHERE {TAG_SQL[n]}" for n in names)


_KEYS = [("d1", "heavy_collector"), ("d2", "internal_user", "external_user"), ("d3", "vpn_user"),
         ("d4", "bulk_downloader"), ("d5", "light_user"), ("d6", "heavy_traffic"), ("d7", "gamer"),
         ("d8", "video_heavy"), ("d9", "balanced"), ("d10", "social"), ("d11", "learner"), ("d12", "technical"),
         ("d13", "night_owl"), ("d14", "early_riser"), ("d15", "regular", "volatile"), ("d16", "possible_scan"),
         ("d17", "suspicious_dns"), ("d18", "abnormal_hours"), ("d19", "weekend_active"),
         ("d20", "morning_active", "afternoon_active")]
for _key, *_names in _KEYS:
    add(f"{_key}_tag_{_names[0]}", over_flows(D.user_tags, *_names), on_flows(_tags(*_names), *FEATURES))
# No flow of the view is of this class: one category is renamed on both sides.
add("d11_tag_learner_renamed", lambda spark, sf: D.user_tags(
    V.flows(spark, sf).replace({"Game": "Education Portal"}, subset=["app_category"]), "learner"),
    on_flows(_tags("learner"), *FEATURES).replace("THEN 'Game'", "THEN 'Education Portal'"))
add("d_all_tags", over_flows(D.user_tags), on_flows(_tags(*D.TAGS), *FEATURES))
add("d21_tag_index", over_flows(D.tag_index), on_flows(
    f"SELECT tag, count(*) AS users FROM ({_tags(*D.TAGS)}) GROUP BY 1", *FEATURES))
add("d21_users_with_tag", over_flows(D.users_with_tag, "technical"), on_flows(
    f"SELECT 'technical' AS tag, {U}, {big('bytes')} AS total_bytes FROM f WHERE {TAG_SQL['technical']}", *FEATURES))

# --- nested profiles ----------------------------------------------------------------------
add("c16_profiles", over_flows(C.profiles))
add("c16_profile_tags_long",
    lambda spark, sf: over_flows(C.profiles)(spark, sf).selectExpr("user", "explode(tags) AS tag"),
    on_flows(_tags(*D.TAGS), *FEATURES))
add("c16_profile_daily_long",
    lambda spark, sf: over_flows(C.profiles)(spark, sf).selectExpr("user", "explode(daily_bytes) AS (day, bytes)"),
    on_flows(f"SELECT {U}, CAST(CAST({T} AS DATE) AS VARCHAR) AS day, {big('sum(bytes)')} AS bytes FROM flows GROUP BY 1, 2"))
_ranked = (f"lead AS (SELECT {U}, category AS c FROM (SELECT *, row_number() OVER (PARTITION BY {U} ORDER BY b DESC, category) AS r "
           "FROM uc WHERE b > 0) WHERE r = 1)")
_list = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(D.TAGS))
add("c17_text_summary", over_flows(C.text_summary), on_flows(
    f"SELECT f.{U}, f.{U} || ': ' || f.bytes || ' bytes in ' || f.n || ' rows, mostly ' || coalesce(lead.c, 'unknown') "
    f"|| ', tags: ' || coalesce(t.tags, 'none') AS summary FROM f LEFT JOIN lead USING ({U}) LEFT JOIN "
    f"(SELECT {U}, string_agg(tag, ', ' ORDER BY CASE tag {_list} END) AS tags FROM ({_tags(*D.TAGS)}) GROUP BY 1) t USING ({U})",
    *FEATURES, _ranked))


def _profile_sections(spark, sf):
    """All maps of the profiles in one long typed frame."""
    full = C.profiles(V.flows(spark, sf))

    def entries(section: str, column: str, value) -> Column:
        return F.transform(F.map_entries(column), lambda e: F.struct(
            F.lit(section).alias("section"), e["key"].cast("string").alias("name"), value(e["value"]).cast("double").alias("amount")))

    single = F.array(*(F.struct(F.lit("single").alias("section"), F.lit(name).alias("name"), F.col(column).cast("double").alias("amount"))
                       for name, column in (("total_bytes", "total_bytes"), ("total_packets", "total_packets"),
                                            ("dns_queries", "dns_stats.dns_queries"), ("dns_bytes", "dns_stats.dns_bytes"))))
    same = lambda v: v
    return full.select("user", F.inline(F.concat(
        single, entries("category_pct", "category_pct", same), entries("protocol_ratio", "protocol_ratio", same), entries("port_stats", "port_stats", same),
        entries("daily_bytes", "daily_bytes", same), entries("hour_bytes", "active_hours", lambda v: v["bytes"]),
        entries("hour_count", "active_hours", lambda v: v["count"])))).where("amount is not null")


_dbl = "CAST({} AS DOUBLE)".format
_one = {"total_bytes": "sum(bytes)", "total_packets": "count(*)", "dns_queries": "count(*) FILTER (WHERE dst_port = 53)",
        "dns_bytes": "coalesce(sum(bytes) FILTER (WHERE dst_port = 53), 0)"}
add("c16_profile_sections", _profile_sections, on_flows(" UNION ALL ".join([
    *(f"SELECT {U}, 'single' AS section, '{name}' AS name, {_dbl(sql)} AS amount FROM flows GROUP BY 1" for name, sql in _one.items()),
    f"SELECT {U}, 'category_pct', category, pct FROM cs",
    f"SELECT {U}, 'protocol_ratio', protocol, {pct('b', 'sum(b) OVER (PARTITION BY ' + U + ')')} FROM (SELECT {U}, protocol, sum(bytes) AS b FROM flows GROUP BY 1, 2)",
    f"SELECT {U}, 'port_stats', CAST(dst_port AS VARCHAR), {_dbl('count(*)')} FROM flows WHERE dst_port IN ({_watched}) GROUP BY 1, 3",
    f"SELECT {U}, 'daily_bytes', CAST(CAST({T} AS DATE) AS VARCHAR), {_dbl('sum(bytes)')} FROM flows GROUP BY 1, 3",
    f"SELECT {U}, 'hour_bytes', CAST({HOUR} AS VARCHAR), {_dbl('sum(bytes)')} FROM flows GROUP BY 1, 3",
    f"SELECT {U}, 'hour_count', CAST({HOUR} AS VARCHAR), {_dbl('count(*)')} FROM flows GROUP BY 1, 3"]), *SHARES))

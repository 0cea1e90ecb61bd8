"""Outlier models (family F)."""



from flowloom import schema as S
from flowloom.catalog.base import add, half_up, on_flows
from flowloom.operators.anomaly import ensemble as M
from flowloom.operators.anomaly import features as U
from flowloom.sources import sample_views as V

USER, T = '"user"', '"timestamp"'
_susp = ", ".join(map(str, S.SUSPICIOUS_PORTS))
_d = "CAST({} AS DOUBLE)".format
FEATURES = f"""
feats AS (SELECT a.{USER}, {_d('b')} AS total_bytes, {_d('n')} AS total_packets, {_d('ips')} AS unique_dst_ips,
  {_d('ports')} AS unique_dst_ports, {_d('susp')} AS suspicious_port_hits,
  CASE WHEN b > 0 THEN {_d('night')} / {_d('b')} ELSE {_d('0')} END AS night_byte_ratio, {_d('dns')} AS dns_query_count,
  {_d('mh')} AS max_hour_bytes, {_d('ah')} AS active_hour_count, {_d('b')} / {_d('n')} AS avg_bytes_per_packet
  FROM (SELECT {USER}, sum(bytes) AS b, count(*) AS n, count(DISTINCT dst_ip) AS ips, count(DISTINCT dst_port) AS ports,
    count(*) FILTER (WHERE dst_port IN ({_susp})) AS susp, count(*) FILTER (WHERE dst_port = 53) AS dns,
    coalesce(sum(bytes) FILTER (WHERE hour({T}) BETWEEN 0 AND 5), 0) AS night FROM flows GROUP BY 1) a
  JOIN (SELECT {USER}, max(x) AS mh, count(*) FILTER (WHERE x > 0) AS ah FROM
    (SELECT {USER}, hour({T}) AS h, sum(bytes) AS x FROM flows GROUP BY 1, 2) GROUP BY 1) h ON a.{USER} = h.{USER})"""


def _rounded(digits: int) -> str:
    return ", ".join(f"{half_up(c, digits)} AS {c}" for c in S.FEATURE_NAMES)


def _round_cols(frame, digits):
    return frame.selectExpr("user", *[f"floor({c} * {10 ** digits}D + 0.5D) / {10 ** digits}D AS {c}" for c in S.FEATURE_NAMES])


add("f1_features", lambda spark, sf: _round_cols(U.feature_table(V.flows(spark, sf)), 4),
    on_flows(f"SELECT {USER}, {_rounded(4)} FROM feats", FEATURES.strip()))
_z = ", ".join(
    half_up(f"CASE WHEN coalesce(stddev_pop({c}) OVER (), 0) <= abs(avg({c}) OVER ()) * CAST(1e-12 AS DOUBLE) THEN CAST(0 AS DOUBLE) "
            f"ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END", 5) + f" AS {c}" for c in S.FEATURE_NAMES)
add("f2_standardise", lambda spark, sf: _round_cols(U.standardise(U.feature_table(V.flows(spark, sf))), 5),
    on_flows(f"SELECT {USER}, {_z} FROM feats", FEATURES.strip()))
add("f7_score_scaling",
    lambda spark, sf: U.scaled_scores(U.feature_table(V.flows(spark, sf)), "total_bytes").select("user", "anomaly_score"),
    on_flows(f"SELECT {USER}, {half_up('(total_bytes - (SELECT min(total_bytes) FROM feats)) / ((SELECT max(total_bytes) FROM feats) - (SELECT min(total_bytes) FROM feats)) * CAST(100 AS DOUBLE)', 2)} AS anomaly_score FROM feats",
             FEATURES.strip()))
_long = " UNION ALL ".join(f"SELECT {USER}, {i} AS i, '{c}' AS name, {c} AS x FROM feats" for i, c in enumerate(S.FEATURE_NAMES))
add("f8_evidence_within_user",
    lambda spark, sf: U.within_user_evidence(U.feature_table(V.flows(spark, sf))).selectExpr(
        "user", "array_join(evidence, '; ') AS evidence"),
    on_flows(f"SELECT {USER}, string_agg(name || '=' || printf('%.2f', {half_up('x', 2)}), '; ' ORDER BY r) AS evidence FROM "
             f"(SELECT *, row_number() OVER (PARTITION BY {USER} ORDER BY {half_up('z', 9)} DESC, i) AS r FROM "
             f"(SELECT *, abs(x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM ({_long}) WINDOW w AS (PARTITION BY {USER}))) "
             "WHERE r <= 3 GROUP BY 1", FEATURES.strip()))


def _model(name):
    def run(spark, sf):
        return M.model_report(V.flows(spark, sf), name)["scores"]
    return run


_nine = ", ".join(
    half_up(f"CASE WHEN coalesce(stddev_pop({c}) OVER (), 0) <= abs(avg({c}) OVER ()) * CAST(1e-12 AS DOUBLE) THEN CAST(0 AS DOUBLE) "
            f"ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END", 9) for c in S.FEATURE_NAMES)
_square = " + ".join(f"(a.v[{i}] - b.v[{i}]) * (a.v[{i}] - b.v[{i}])" for i in range(1, len(S.FEATURE_NAMES) + 1))
#: The factor by all pairs: equal vectors are one point with a weight, neighbours are cut at k by distance and then digest.
_FACTOR = f"""
vecs AS (SELECT {USER}, [{_nine}] AS v FROM feats),
pts AS (SELECT v, count(*) AS w, md5(array_to_string([CAST(round(x * CAST(1e9 AS DOUBLE)) AS BIGINT) FOR x IN v], ',')) AS vid FROM vecs GROUP BY v),
size AS (SELECT count(*) AS n, least(20, count(*) - 1) AS k FROM vecs),
pairs AS (
  SELECT a.vid, b.vid AS nid, round(sqrt({_square}), 12) AS dist, b.w FROM pts a JOIN pts b ON a.vid <> b.vid
  UNION ALL SELECT vid, vid, CAST(0 AS DOUBLE), w - 1 FROM pts WHERE w > 1),
near AS (
  SELECT vid, nid, dist, least(w, k - before) AS w FROM (
    SELECT *, coalesce(sum(w) OVER (PARTITION BY vid ORDER BY dist, nid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pairs), size
  WHERE before < k),
kdist AS (SELECT vid, max(dist) AS kd FROM near GROUP BY 1),
lrd AS (
  SELECT n.vid, CAST(1 AS DOUBLE) / (sum(greatest(d.kd, n.dist) * n.w) / sum(n.w) + CAST(1e-10 AS DOUBLE)) AS lrd
  FROM near n JOIN kdist d ON d.vid = n.nid GROUP BY 1),
factor AS (
  SELECT n.vid, round(sum(m.lrd * n.w) / sum(n.w) / any_value(l.lrd), 9) AS o FROM near n JOIN lrd m ON m.vid = n.nid JOIN lrd l ON l.vid = n.vid GROUP BY n.vid),
scored AS (SELECT v.{USER}, f.o FROM vecs v JOIN pts p ON p.v = v.v JOIN factor f ON f.vid = p.vid),
place AS (SELECT list(o ORDER BY o) AS os, any_value(n) AS n, (CAST(1 AS DOUBLE) - least(CAST(0.1 AS DOUBLE), greatest(
  CAST(1 AS DOUBLE) / any_value(n), CAST(0.01 AS DOUBLE)))) * (any_value(n) - 1) AS pos FROM scored, size),
cut AS (SELECT os[CAST(floor(pos) AS BIGINT) + 1] + (pos - floor(pos)) * (os[least(CAST(floor(pos) AS BIGINT) + 2, n)] - os[CAST(floor(pos) AS BIGINT) + 1])
  AS c FROM place)"""
_lof = _model("local_outlier_factor")
add("f3_isolation_forest", _model("isolation_forest"))
add("f4_local_outlier_factor", lambda spark, sf: _lof(spark, sf).selectExpr(
    "user", "floor(outlyingness * 10000D + 0.5D) / 10000D AS outlyingness", "is_anomaly", "anomaly_score"),
    on_flows(f"SELECT {USER}, {half_up('o', 4)} AS outlyingness, o > (SELECT c FROM cut) AS is_anomaly, "
             f"CASE WHEN max(o) OVER () - min(o) OVER () < CAST(1e-9 AS DOUBLE) THEN CAST(50 AS DOUBLE) ELSE "
             + half_up("(o - min(o) OVER ()) / (max(o) OVER () - min(o) OVER ()) * CAST(100 AS DOUBLE)", 2) + " END AS anomaly_score FROM scored",
             FEATURES.strip(), _FACTOR.strip()))
add("f5_one_class_svm", _model("one_class_svm"))
add("f6_ensemble_vote", lambda spark, sf: M.ensemble(V.flows(spark, sf))["anomalies"])
add("f10_model_summary", lambda spark, sf: M.model_report(V.flows(spark, sf), "isolation_forest")["summary"])

# The vote and the summary over scores that SQL has too: three features taken as raw scores.
_SCORED = ("total_bytes", "total_packets", "unique_dst_ports")


def feature_scores(spark, sf) -> dict:
    """Flagged and scaled scores of three features."""
    features, _, users = M.prepare(V.flows(spark, sf))
    return {c: U.flag_outliers(features.select("user", features[c].alias("outlyingness")), users) for c in _SCORED}


def _vote(spark, sf):
    lists = None
    for name, scored in feature_scores(spark, sf).items():
        best = scored.where("is_anomaly").orderBy(scored["anomaly_score"].desc(), "user").limit(10).selectExpr(f"'{name}' AS model", "user", "anomaly_score")
        lists = best if lists is None else lists.unionByName(best)
    return M.vote(lists)


SCORES = f"""
fl AS (SELECT * FROM ({_long}) WHERE name IN {_SCORED}),
pl AS (SELECT name, list(x ORDER BY x) AS os, count(*) AS n, min(x) AS lo, max(x) AS hi, (CAST(1 AS DOUBLE) - least(CAST(0.1 AS DOUBLE), greatest(
  CAST(1 AS DOUBLE) / count(*), CAST(0.01 AS DOUBLE)))) * (count(*) - 1) AS pos FROM fl GROUP BY 1),
sc AS (
  SELECT name AS model, {USER}, x > os[CAST(floor(pos) AS BIGINT) + 1] + (pos - floor(pos)) * (
      os[least(CAST(floor(pos) AS BIGINT) + 2, n)] - os[CAST(floor(pos) AS BIGINT) + 1]) AS flag,
    CASE WHEN hi - lo < CAST(1e-9 AS DOUBLE) THEN CAST(50 AS DOUBLE) ELSE {half_up('(x - lo) / (hi - lo) * CAST(100 AS DOUBLE)', 2)} END AS score
  FROM fl JOIN pl USING (name))"""
add("f6_vote_of_feature_scores", _vote, on_flows(
    "SELECT *, CASE WHEN anomaly_score >= 85 THEN 'critical' WHEN anomaly_score >= 70 THEN 'high' WHEN anomaly_score >= 50 THEN 'medium' ELSE 'low' END "
    f"AS severity FROM (SELECT {USER}, count(*) AS votes, {half_up('avg(score)', 2)} AS anomaly_score, string_agg(model, ', ' ORDER BY model) AS voting_models "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, {USER}) AS r FROM sc WHERE flag) WHERE r <= 10 GROUP BY 1 "
    f"HAVING count(*) >= 2 ORDER BY 3 DESC, 1 LIMIT 10)", FEATURES.strip(), SCORES.strip()))
add("f10_summary_of_feature_scores", lambda spark, sf: U.model_summary(feature_scores(spark, sf)["total_bytes"]), on_flows(
    "SELECT count(*) AS total_users, count(*) FILTER (flag) AS anomaly_users, count(*) FILTER (NOT flag) AS normal_users, max(score) AS max_score, "
    f"{half_up('median(score)', 2)} AS median_score FROM sc WHERE model = 'total_bytes'", FEATURES.strip(), SCORES.strip()))

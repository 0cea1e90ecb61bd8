import pytest

from flowloom.functions import quantiles as Q
from flowloom.operators import adhoc as H
from flowloom.operators import profile as C
from flowloom.operators import rules as R
from flowloom.operators import tags as D
from flowloom.operators import traffic as B

MIB = 1024 * 1024


def _at(seconds):
    return f"2024-01-03 12:{seconds // 60:02d}:{seconds % 60:02d}"


@pytest.mark.parametrize("ports, targets, rows, fires", [(7, 1, 7, 0), (8, 1, 8, 1), (1, 9, 9, 0), (1, 10, 10, 1), (5, 1, 39, 0), (5, 1, 40, 1), (4, 1, 60, 0)])
def test_scan_thresholds(make_flows, ports, targets, rows, fires):
    flows = make_flows(*[{"dst_port": 100 + i % ports, "dst_ip": f"8.8.8.{i % targets}"} for i in range(rows)])
    out = R.reconnaissance(flows).collect()
    assert len(out) == fires
    if fires:
        assert out[0]["score"] == min(95, 45 + 4 * ports + 3 * targets)


def test_group_rules_at_their_limits(make_flows):
    ssh = [{"dst_port": 22, "user": "three"}] * 3 + [{"dst_port": 22, "user": "two"}] * 2
    out = {r["entity"]: r["score"] for r in R.sensitive_service(make_flows(*ssh)).collect()}
    assert out == {"three / 10.0.0.1": 38 + 15 + 8}
    night = [{"timestamp": f"2024-01-03 05:59:{i:02d}", "user": "n"} for i in range(10)] + [{"timestamp": f"2024-01-03 06:00:{i:02d}", "user": "d"} for i in range(10)]
    assert [r["entity"] for r in R.off_hours(make_flows(*night)).collect()] == ["n"]
    dns = [{"dst_port": 53, "bytes": 101, "user": "t"}] * 101 + [{"dst_port": 53, "bytes": 100, "user": "same"}] * 101
    assert [(r["entity"], r["score"]) for r in R.dns_tunneling(make_flows(*dns)).collect()] == [("t", 50 + 10 + 10)]
    leak = [{"dst_port": 443, "bytes": 10 * MIB, "user": "x"}, {"dst_port": 443, "bytes": 10 * MIB - 1, "user": "y"}]
    assert [(r["entity"], r["score"]) for r in R.data_exfiltration(make_flows(*leak)).collect()] == [("x", 45 + 2 + 3)]
    sweep = [{"dst_ip": f"8.8.8.{i % 5}", "timestamp": _at(i)} for i in range(10)]
    assert R.port_sweep(make_flows(*sweep)).first()["score"] == 40 + 15 + 5
    assert R.port_sweep(make_flows(*sweep[:9])).count() == 0


def test_volume_rule_compares_with_the_median(make_flows):
    rows = [{"user": f"u{i}", "bytes": 1_000_000} for i in range(5)] + [{"user": "big", "bytes": 20 * MIB}, {"user": "mid", "bytes": 4_999_999}]
    out = R.traffic_anomaly(make_flows(*rows)).collect()
    assert [(r["entity"], r["score"]) for r in out] == [("big", 85)]
    assert R.traffic_anomaly(make_flows({"user": "alone", "bytes": 90 * MIB})).count() == 0


def test_beacon_gaps_do_not_depend_on_chunks(make_flows):
    beat = [{"timestamp": _at(60 * i)} for i in range(6)] + [{"timestamp": _at(0)}]
    flows = make_flows(*beat)
    out = R.beaconing(flows).first()
    assert out["score"] == 40 + 0 + 25 and "rows=7" in out["evidence"]
    noisy = [{"timestamp": _at(s)} for s in (0, 5, 100, 110, 400, 1000)]
    assert R.beaconing(make_flows(*noisy)).count() == 0
    frames = [R.connection_gaps(make_flows(*noisy), c).first() for c in (1, 60, 300, 10_000)]
    assert len({(f["gaps"], f["sum_us"], round(f["sum_sq"], 6)) for f in frames}) == 1
    assert frames[0]["gaps"] == 5 and frames[0]["sum_us"] == 1_000_000_000


def test_text_rules_report_five_terms_in_list_order(make_flows):
    text = "POWERSHELL base64 <script onerror= ../ cmd.exe union select"
    out = R.text_indicators(make_flows({"payload": text}, {"payload": "plain"}, {"payload": "请忽略以上"})).collect()
    by_type = {r["type"]: r for r in out}
    assert set(by_type) == {"web_payload_attack", "prompt_injection"}
    assert by_type["web_payload_attack"]["evidence"] == "terms=union select, ../, <script, onerror=, cmd.exe"


def test_alert_ids_are_gapless_and_blocks_ranked(spark, small):
    from flowloom.sources import sample_views as V

    alerts = R.all_alerts(V.flows(spark, small))
    ids = [r["id"] for r in R.with_alert_ids(alerts).select("id", "rule_no").orderBy("id").collect()]
    assert ids == [f"SEC-{i:04d}" for i in range(1, len(ids) + 1)] and len(ids) == alerts.count()
    blocked = {r["max_score"] >= 85: r for r in R.block_list(alerts).collect()}
    assert blocked[True]["action"] == "quarantine" and blocked[True]["ttl_minutes"] == 30


def test_no_flows_give_low_risk(make_flows):
    flows = make_flows({}).where("false")
    row = R.risk_summary(R.all_alerts(flows)).first()
    assert (row["risk_score"], row["risk_level"], row["total_alerts"]) == (0, "low", 0)
    assert B.totals(flows).first()["total_bytes"] == 0 and B.growth(flows).first()[0] == 0.0
    assert B.trend(flows).count() == 0 and len(B.idle_hours(flows).collect()) == 24


def _tags(flows):
    out = {}
    for r in D.user_tags(flows).collect():
        out.setdefault(r["user"], set()).add(r["tag"])
    return out


def test_one_user_per_tag(make_flows):
    def many(n, **row):
        return [row] * n

    rows = [
        *many(101, user="collector", bytes=100), *many(100, user="not_collector", bytes=100),
        {"user": "outside", "src_ip": "8.8.4.4"}, {"user": "edge", "src_ip": "172.31.0.1"}, {"user": "beyond", "src_ip": "172.32.0.1"},
        {"user": "vpn", "protocol": "UDP", "bytes": 21}, {"user": "vpn", "bytes": 79},
        {"user": "no_vpn", "protocol": "UDP", "bytes": 20}, {"user": "no_vpn", "bytes": 80},
        {"user": "gamer", "app_category": "Online Gaming", "bytes": 31}, {"user": "gamer", "bytes": 69},
        {"user": "viewer", "app_category": "Video Streaming", "bytes": 41}, {"user": "viewer", "bytes": 59},
        {"user": "social", "app_category": "Social Media", "bytes": 20}, {"user": "social", "app_category": "Chat", "bytes": 11}, {"user": "social", "bytes": 69},
        {"user": "learner", "app_category": "Education", "bytes": 21}, {"user": "learner", "bytes": 79},
        {"user": "even", "app_category": "Game", "bytes": 30}, {"user": "even", "app_category": "Web", "bytes": 30}, {"user": "even", "app_category": "DNS", "bytes": 39},
        *many(21, user="tech", dst_port=22), *[{"user": "scanner", "dst_port": p} for p in (22, 3389, 8080)],
        *many(51, user="dns", dst_port=53), {"user": "owl", "timestamp": "2024-01-03 23:10:00", "bytes": 61}, {"user": "owl", "bytes": 39},
        {"user": "early", "timestamp": "2024-01-03 09:59:00", "bytes": 31}, {"user": "early", "timestamp": "2024-01-03 18:00:00", "bytes": 69},
        {"user": "weekend", "timestamp": "2024-01-06 15:00:00", "bytes": 11}, {"user": "weekend", "bytes": 10},
    ]
    tags = _tags(make_flows(*rows))
    has = [("collector", "heavy_collector"), ("outside", "external_user"), ("edge", "internal_user"), ("beyond", "external_user"),
           ("vpn", "vpn_user"), ("gamer", "gamer"), ("viewer", "video_heavy"), ("social", "social"), ("learner", "learner"),
           ("even", "balanced"), ("tech", "technical"), ("scanner", "possible_scan"), ("dns", "suspicious_dns"), ("owl", "night_owl"),
           ("owl", "abnormal_hours"), ("early", "early_riser"), ("weekend", "weekend_active"), ("gamer", "afternoon_active"),
           ("gamer", "light_user")]
    lacks = [("not_collector", "heavy_collector"), ("no_vpn", "vpn_user"), ("edge", "external_user"), ("tech", "possible_scan"),
             ("scanner", "technical"), ("gamer", "balanced"), ("early", "morning_active")]
    assert [(u, t) for u, t in has if t not in tags[u]] == []
    assert [(u, t) for u, t in lacks if t in tags[u]] == []


def test_profiles_hold_all_sections(make_flows):
    row = C.profiles(make_flows({"bytes": 30}, {"bytes": 10, "protocol": "UDP", "dst_port": 53, "timestamp": "2024-01-04 01:00:00"},
                                {"bytes": 60, "dst_port": 22})).first()
    assert row["protocol_ratio"] == {"TCP": 90.0, "UDP": 10.0} and row["port_stats"] == {22: 1}
    assert row["daily_bytes"] == {"2024-01-03": 90, "2024-01-04": 10} and row["dns_stats"].asDict() == {"dns_queries": 1, "dns_bytes": 10}
    assert row["active_hours"][12].asDict() == {"bytes": 90, "count": 2} and row["category_pct"] == {"others": 100.0}


def test_user_report_for_one_user_uses_whole_population(make_flows):
    flows = make_flows({"user": "a"}, {"user": "b", "bytes": 300}, {"user": "a", "dst_ip": "1.1.1.1"})
    row = H.user_full_report(flows, "a").first()
    assert (row["user"], row["unique_destinations"], row["total_bytes"]) == ("a", 2, 200) and "internal_user" in row["tags"]


@pytest.mark.parametrize("values", [[5], [1, 2], [0, 0, 0, 7], list(range(1000)), [2 ** 40, 3, 2 ** 62, 2 ** 21, 2 ** 21 + 1, 9]])
def test_exact_quantiles(spark, values):
    import numpy as np

    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    got = Q.exact_quantiles(df, "x", probs).first()
    want = np.quantile(np.array(values, dtype=float), list(probs.values()))
    assert np.allclose([got[k] for k in probs], want, rtol=1e-12)


def test_exact_quantiles_of_doubles_and_nothing(spark):
    df = spark.createDataFrame([(0.0,), (1e-9,), (3.5,), (8.0 - 1e-15,), (8.0,), (1e24,)], "x double")
    assert Q.exact_quantiles(df, "x", {"m": 0.5}, Q.double_key).first()["m"] == pytest.approx((3.5 + 8.0) / 2)
    assert Q.exact_quantiles(df.where("false"), "x", {"m": 0.5}, Q.double_key).first()["m"] is None


def test_search_is_literal_unless_asked(make_flows):
    flows = make_flows({"src_ip": "10.0.0.1"}, {"src_ip": "10a0b0c1"})
    assert H.search_totals(flows, "10.0.0.1").first()["total_matches"] == 1
    assert H.search_totals(flows, "10.0.0.1", regex=True).first()["total_matches"] == 2
    with pytest.raises(ValueError):
        H.search_filter("  ")


def test_single_bucket_scores_zero(make_flows):
    assert B.anomaly_timeline(make_flows({}, {})).first()["anomaly_score"] == 0.0


def test_sample_is_exact_and_repeatable(spark, small):
    from flowloom.sources import sample_views as V

    flows = V.flows(spark, small)
    one = {r[0] for r in B.exact_sample(flows, 0.05, 1).select("flow_id").collect()}
    two = {r[0] for r in B.exact_sample(flows.repartition(3), 0.05, 1).select("flow_id").collect()}
    assert one == two and len(one) == int(flows.count() * 0.05)

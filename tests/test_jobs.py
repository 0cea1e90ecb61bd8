from flowloom.plans import jobs
from flowloom.sources import csvfiles
from flowloom.sources import sample_views as V


def test_full_analysis_writes_every_table(spark, small, tmp_path):
    source, table, out = str(tmp_path / "csv"), str(tmp_path / "flows"), str(tmp_path / "out")
    V.flows(spark, small).drop("payload").write.option("header", True).csv(source)
    flows = jobs.ingest(spark, source, table, "2024-02-01 00:00:00")
    again = jobs.ingest(spark, source, str(tmp_path / "again"), "2024-02-01 00:00:00")
    assert flows.select("flow_id").distinct().count() == flows.count()
    assert flows.select("flow_id").exceptAll(again.select("flow_id")).count() == 0
    assert flows.count() == V.flows(spark, small).count()
    results = jobs.full_analysis(flows, out)
    assert results["busiest_hours"].count() == 5
    users = flows.select("user").distinct().count()
    assert results["profiles"].count() == users == results["anomaly_scores"].count()
    alerts = results["alerts"]
    assert results["summary"].first()["total_alerts"] == alerts.count() == alerts.select("id").distinct().count()
    board = jobs.dashboard(flows, out, alerts)
    assert board["attack_sources"].first()["blocked"] == results["block_list"].count()
    profiles = str(tmp_path / "profiles")
    csvfiles.write_profiles(results["profiles"], profiles)
    again = csvfiles.read_profiles(spark, profiles, results["profiles"])
    key = lambda rows: sorted(repr(r) for r in rows)
    assert key(again.collect()) == key(results["profiles"].collect())

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowloom.sources import sample_views as V
from flowloom.streaming import live as G
from flowloom.streaming.scans import late_counts


def _write_stream_input(spark, small, tmp_path, files=3):
    flows = V.flows(spark, small).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path = str(tmp_path / "in")
    flows.select(*G.live_schema().fieldNames()).repartition(files, "src_ip").write.parquet(path)
    return path, flows


def _drain(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def _same(got, want):
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_buckets_rates_and_totals_equal_batch(spark, small, tmp_path):
    path, flows = _write_stream_input(spark, small, tmp_path, 5)
    seconds, totals = G.second_increments(spark, str(tmp_path / "s")), G.total_increments(spark, str(tmp_path / "t"))
    for table, name in ((seconds, "c1"), (totals, "c2")):
        table.start(G.read_stream(spark, path, 1), str(tmp_path / name), compact_every=2).awaitTermination(120)
    _same(G.read_buckets(seconds), G.traffic_buckets(flows))
    _same(G.read_rate(seconds), G.event_rate(flows))
    scans = G.port_scan_alerts(flows)
    got, want = G.read_totals(totals, scans).first(), G.running_totals(flows).first()
    for c in ("events", "total_bytes", "alerts", "last_event_at"):
        assert got[c] == want[c]
    assert want["unique_users"] == flows.select("user").distinct().count()
    for c in ("unique_users", "unique_src_ips"):
        assert abs(got[c] - want[c]) <= 0.03 * want[c]
    assert want["alerts"] == G.large_flows(flows).count() + G.sensitive_ports(flows).count() + scans.count()


def test_late_events_and_retried_batches_in_increments(spark, tmp_path):
    start = datetime(2024, 1, 10, 2)

    def batch(*seconds):
        return spark.createDataFrame([(i, start + timedelta(seconds=s), "10.0.0.1", "8.8.8.8", 1, 443, "TCP", 10, "", "u")
                                      for i, s in enumerate(seconds)], G.live_schema())

    table = G.second_increments(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(batch(0, 1, 7200), 0)
    table.write(batch(3600, 2), 1)  # an hour and two late
    table.write(batch(3600, 2), 1)  # retried
    want = sorted([(start, 30, 3), (start + timedelta(hours=1), 10, 1), (start + timedelta(hours=2), 10, 1)])

    def check():
        assert sorted(map(tuple, G.read_buckets(table).collect())) == want

    check()
    for epoch in range(2, 24):
        table.write(batch(5 * epoch), epoch)
        want.append((start + timedelta(seconds=5 * epoch), 10, 1))
        if epoch % 2:
            before = table.read()  # what a reader has listed stays readable through the next compaction
            table.compact(wide=4)
            assert before.count() == len(table.read().collect())
        want.sort()
        check()
        table.write(batch(5 * epoch), epoch)  # the newest batch is retried after a compaction
        check()
    runs, singles = table._folders()
    assert len(runs) + len(singles) < 12
    (tmp_path / "s" / "run=0-99").mkdir()  # a compaction that failed half way counts for nothing
    check()


def test_stateless_alerts_equal_batch_and_are_kept_by_date(spark, small, tmp_path):
    path, flows = _write_stream_input(spark, small, tmp_path)
    events = G.read_stream(spark, path)
    alerts = G.large_flows(events).unionByName(G.sensitive_ports(events))
    table, checkpoint = str(tmp_path / "alerts"), str(tmp_path / "ck")
    G.write_alerts(alerts, table, checkpoint).awaitTermination(120)
    stored = spark.read.parquet(table)
    want = G.large_flows(flows).count() + G.sensitive_ports(flows).count()
    assert stored.count() == want
    G.write_alerts(alerts, table, checkpoint).awaitTermination(120)  # a restart adds nothing
    assert spark.read.parquet(table).count() == want
    newest = [r["ts"] for r in G.alert_history(stored, 50).collect()]
    assert len(newest) == 50 and newest == sorted(newest)


def _replay(rows):
    """The scan rule over rows in time order, as plain Python."""
    seen, fired = {}, []
    for ts, ip, port in sorted(rows):
        memory = seen.setdefault(ip, [])
        memory.append((ts, port))
        del memory[:-64]
        ports = {p for t, p in memory if ts - t <= timedelta(seconds=30)}
        if len(ports) >= 6:
            fired.append((ip, ts, len(ports)))
            memory.clear()
    return sorted(fired)


def test_scan_rule_fires_and_clears_like_a_replay(spark, tmp_path):
    start = datetime(2024, 1, 10, 2)
    rows = [(start + timedelta(seconds=i), f"10.7.{s}.4", 1000 + i) for s in range(4) for i in range(25)]
    rows += [(start + timedelta(seconds=40 * i), "10.1.1.1", 2000 + i) for i in range(10)]  # too slow to fire
    rows += [(start + timedelta(seconds=i), "10.2.2.2", 443 + i % 5) for i in range(60)]  # five ports only
    data = [(i, ts, ip, "8.8.8.8", 1, port, "TCP", 60, "", "u") for i, (ts, ip, port) in enumerate(rows)]
    path = str(tmp_path / "scan")
    spark.createDataFrame(data, G.live_schema()).write.parquet(path)
    got = _drain(G.port_scans(G.read_stream(spark, path)), "scans").collect()
    want = _replay(rows)
    assert len(want) == 16
    assert sorted((r["entity"], r["ts"], int(r["detail"].split()[0])) for r in got) == want


def _scan_input(spark, tmp_path, rows, name):
    """One stream batch per list of (time, source, port)."""
    number = 0
    for i, part in enumerate(rows):
        data = []
        for ts, ip, port in part:
            data.append((number, ts, ip, "8.8.8.8", 1, port, "TCP", 60, "", "u"))
            number += 1
        spark.createDataFrame(data, G.live_schema()).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        time.sleep(0.05)  # files are read in the order of their times
    return G.read_stream(spark, str(tmp_path / name), 1)


def test_stream_of_scans_equals_batch_in_any_arrival_order(spark, tmp_path):
    rnd = random.Random(8)
    start = datetime(2024, 1, 10, 2)
    rows = [(start + timedelta(seconds=rnd.randrange(300), microseconds=i), f"10.0.0.{rnd.randrange(3)}", rnd.randrange(1, 12)) for i in range(400)]
    rows += [(start + timedelta(seconds=i), "10.9.9.9", 1000 + i) for i in range(290)]
    end = [(start + timedelta(hours=3), "10.1.1.1", 1), (start + timedelta(hours=5), "10.1.1.1", 1)]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    orders = {"sorted": sorted(rows), "shuffled": shuffled}
    for name, order in orders.items():
        events = _scan_input(spark, tmp_path, [order[i::3] if name == "shuffled" else order[i * 230:(i + 1) * 230] for i in range(3)] + [end[:1], end[1:]], name)
        stream = _drain(G.scan_events(events, "10 minutes"), f"scan_{name}")
        assert stream.where("title = 'late_hit'").count() == 0
        flows = spark.read.parquet(str(tmp_path / name))
        got = sorted(map(tuple, stream.collect()))
        assert got == sorted(map(tuple, G.port_scan_alerts(flows).collect())) and len(got) > 50
        assert sorted((r[3], r[0], int(r[4].split()[0])) for r in got) == _replay(rows)


def test_late_hits_are_counted(spark, tmp_path):
    start = datetime(2024, 1, 10, 2)
    at = lambda s: start + timedelta(seconds=s)
    batches = [[(at(1000 + i), "10.0.0.1", i) for i in range(3)], [(at(2000), "10.0.0.2", 1)],
               [(at(i), "10.0.0.1", 50 + i) for i in range(7)] + [(at(2001), "10.0.0.1", 9)], [(at(9000), "10.0.0.3", 1)], [(at(9999), "10.0.0.3", 1)]]
    rows = _drain(G.scan_events(_scan_input(spark, tmp_path, batches, "late"), "30 seconds"), "late_scans")
    assert [tuple(r) for r in late_counts(rows).collect()] == [("10.0.0.1", datetime(2024, 1, 10, 2), 7)]
    assert rows.count() == 7


def test_stretches_split_a_source_and_nulls_take_no_part(spark, make_flows):
    start = datetime(2024, 1, 10, 2)
    rows = [(start + timedelta(seconds=s * 100 + i), "10.0.0.1", i) for s in range(20) for i in range(5)]  # pauses keep it below six
    rows += [(start + timedelta(seconds=i * 29), "10.0.0.2", i % 2) for i in range(50)] + [(start, None, 1)]
    rows += [(start + timedelta(milliseconds=i), "10.0.0.3", i % 9) for i in range(3000)]
    flows = make_flows(*[{"timestamp": t.isoformat(sep=" "), "src_ip": ip, "dst_port": p} for t, ip, p in rows])
    got = [(r["entity"], r["ts"], int(r["detail"].split()[0])) for r in G.port_scan_alerts(flows).collect()]
    assert sorted(got) == _replay([r for r in rows if r[1]]) and len(got) == 500
    assert G.port_scan_alerts(flows.where("false")).count() == 0


def test_scan_windows_cut_in_chunks_equal_brute_force(spark, make_flows):
    random.seed(4)
    start = datetime(2024, 1, 10, 2)
    rows = []
    for _ in range(400):
        at = start + timedelta(milliseconds=random.choice([random.randrange(200_000), random.randrange(0, 200_000, 30_000)]))
        rows.append((at, f"10.0.0.{random.randrange(2)}", random.randrange(1, 30)))
    flows = make_flows(*[{"timestamp": t.isoformat(sep=" "), "src_ip": ip, "dst_port": p} for t, ip, p in rows])
    want = set()
    for i, (t, ip, _) in enumerate(rows):
        ports = {p for u, other, p in rows if other == ip and timedelta(0) <= t - u <= timedelta(seconds=30)}
        if len(ports) >= 6:
            want.add((i, len(ports)))
    for chunk in (7, 60):
        got = {(r["flow_id"], r["ports"]) for r in G.port_scan_windows(flows, chunk).collect()}
        assert got == want


def test_counts_survive_a_restart(spark, small, tmp_path):
    path, flows = _write_stream_input(spark, small, tmp_path)
    table, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    for _ in range(2):
        G.stream_counts(G.read_stream(spark, path, 1), "app_category", table, checkpoint).awaitTermination(120)
    got = {r["app_category"]: r["packets"] for r in G.read_counts(spark, table, "app_category").collect()}
    assert got == {r["app_category"]: r["count"] for r in flows.groupBy("app_category").count().collect()}


def test_latest_buckets_fill_gaps(spark):
    rows = [(datetime(2024, 1, 1, 0, 0, 0), 5, 1), (datetime(2024, 1, 1, 0, 0, 15), 7, 2)]
    out = G.latest_buckets(spark.createDataFrame(rows, "ts timestamp, bytes bigint, events bigint")).orderBy("ts").collect()
    assert [(r["bytes"], r["events"]) for r in out] == [(5, 1), (0, 0), (0, 0), (7, 2)]


def test_scan_memory_keeps_every_port_in_reach():
    hits = [(i * 1000, 1 + i) for i in range(5)] + [(6000 + i, 5) for i in range(64)] + [(15_000_000, 6)]
    seen, fired = [], 0
    for ts_us, port in hits:
        seen, count = G.scan_step(seen, ts_us, port)
        fired += count
    assert fired == 6 and seen == []

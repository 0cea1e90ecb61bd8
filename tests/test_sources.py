import ipaddress
import random
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.functions import addresses as A
from flowloom.functions import scalars as X
from flowloom.plans import jobs
from flowloom.sources import canonical as N
from flowloom.sources import capture, csvfiles, history

NOW = "2024-02-01 00:00:00"
HEADER = "timestamp,src_ip,dst_ip,src_port,dst_port,protocol,bytes,app_category,user\n"


def _line(user, size=10):
    return f"2024-01-01 10:00:00,10.0.0.1,8.8.8.8,1000,443,tcp,{size},,{user}\n"


def test_charset_and_header_are_found_per_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    # The first bytes of the long file are plain ASCII: only its last line tells the charset.
    filler = "".join(_line(f"plain{i}") for i in range(2000))
    (folder / "a.csv").write_bytes(("﻿" + HEADER + _line("用户")).encode("utf-8"))
    (folder / "b.csv").write_bytes((HEADER + filler + _line("用户二")).encode("gb18030"))
    (folder / "c.csv").write_bytes((HEADER + "2024-01-01 10:00:00,10.0.0.1,8.8.8.8,1,2,tcp,5,,caf\xe9\xff\n").encode("latin-1"))
    (folder / "d.csv").write_text("ip.src,ip.dst,frame.len\n10.0.0.9,1.1.1.1,77\n")
    flows = csvfiles.scan_csv(spark, str(folder), NOW)
    assert flows.columns == S.CANONICAL_COLUMNS
    users = {r["user"] for r in flows.select("user").distinct().collect()}
    assert {"用户", "用户二", "caf\xe9\xff", "10.0.0.9"} <= users
    assert flows.count() == 2004
    per_file = {r["file"]: (r["records"], r["total_bytes"]) for r in jobs.batch_of_files(spark, str(folder), NOW).collect()}
    assert per_file["d.csv"] == (1, 77) and per_file["b.csv"][0] == 2001


def test_canonical_csv_round_trip_and_partitioned_table(spark, tmp_path):
    source, out, table = tmp_path / "x.csv", str(tmp_path / "out"), str(tmp_path / "table")
    source.write_text(HEADER + _line("a", 1) + _line("b", 2))
    flows = csvfiles.scan_csv(spark, str(source), NOW)
    csvfiles.write_canonical_csv(flows, out)
    again = csvfiles.scan_csv(spark, out, NOW)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, flows.collect()))
    report = csvfiles.import_csv(spark, str(source), table, NOW)
    assert report == {"type": "CSV", "records": 2, "synthesised": []}
    stored = csvfiles.read_flows(spark, table)
    assert stored.count() == 2 and "date" in stored.columns


def test_first_alias_wins_and_addresses_are_required(spark):
    assert N.resolve_columns(["Source IP", "IP.dst", "Host", "Frame.Len", "size"]) == {
        "src_ip": "Source IP", "dst_ip": "IP.dst", "user": "Host", "hostname": "Host", "bytes": "size"}
    with pytest.raises(N.ImportFailure):
        N.canonicalise(spark.createDataFrame([("1",)], "bytes string"), NOW)
    assert N.required_columns(["bytes", "user"]) == (False, ["app_category", "dst_ip", "dst_port", "protocol", "src_ip", "timestamp"])


def test_times_ports_and_sizes(spark):
    rows = [("1700000000.5", "80.9", "12.9"), ("2024-01-02 03:04:05Z", "0", "9007199254740993"), ("9" * 12, "0", "1e30"), ("2024-01-02T03:04:05+02:00", "-0.5", "-1"), ("01/02/2024 03:04", "inf", "inf"),
            ("Jan  2, 2024 03:04:05.123456789 UTC", "65536", "nan"), ("junk", "x", ""), ("2024/1/2 3:4:5", "65535", "1e3")]
    df = spark.createDataFrame(rows, "t string, p string, b string")
    out = df.select(X.parse_time(F.col("t"), F.lit(NOW).cast("timestamp_ntz")), X.to_port(F.col("p")), X.to_bytes(F.col("b"))).collect()
    assert [tuple(r) for r in out] == [
        (datetime(2023, 11, 14, 22, 13, 20, 500000), 80, 12), (datetime(2024, 1, 2, 3, 4, 5), 0, 9007199254740993), (datetime(2024, 2, 1), 0, 0),
        (datetime(2024, 1, 2, 1, 4, 5), 0, 0),
        (datetime(2024, 1, 2, 3, 4), 0, 0), (datetime(2024, 1, 2, 3, 4, 5), 0, 0),
        (datetime(2024, 2, 1), 0, 0), (datetime(2024, 1, 2, 3, 4, 5), 65535, 1000)]
    epochs = [("1700000000500", "ms"), ("1700000000500000", "us"), ("1700000000500000000", "ns")]
    for number, unit in epochs:
        got = spark.createDataFrame([(number,)], "t string").select(X.parse_time(F.col("t"), F.lit(NOW).cast("timestamp_ntz"), unit)).first()[0]
        assert got == datetime(2023, 11, 14, 22, 13, 20, 500000)


def test_private_addresses_match_the_registry(spark):
    random.seed(2)
    texts = ["::", "::1", "fe80::1%eth0", "fdff::1", "2001:db8::1", "2001:1::1", "2001:20::9", "2001:1ff::", "2001:200::",
             "64:ff9b:1::1", "64:ff9b::1", "2002::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "1:2:3:4:5:6:7", "1::2::3", ":1", "12345::",
             "1:2:3:4:5:6:7::", "010.0.0.1", "192.0.0.9", "192.0.0.8", "172.15.0.1", "172.31.9.9", "100.64.0.1", "", "1.2.3", "256.1.1.1"]
    for net in A.PRIVATE_V4:
        first, last = ipaddress.ip_network(net)[0], ipaddress.ip_network(net)[-1]
        texts += [str(first), str(last)] + [str(ipaddress.ip_address(n)) for n in (int(first) - 1, int(last) + 1) if 0 <= n < 2 ** 32]
    texts += [str(ipaddress.IPv6Address(random.getrandbits(128))) for _ in range(30)]

    def private(text):
        try:
            return ipaddress.ip_address(text).is_private
        except ValueError:
            return False

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.is_private(F.col("t")).alias("p")).collect()
    assert [(r["t"], r["p"]) for r in got] == [(t, private(t)) for t in texts]


def test_url_redaction_and_names(spark):
    urls = ["/a/b?token=s&user=x", "http://h/p?a=1#f", "http://h", "/x?", "/x?&", "/q?" + "&".join(f"k{i}={i}" for i in range(10))]
    out = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(X.redact_url(F.col("u"))).collect()]
    assert out == ["/a/b?token&user", "/p?a", "/", "/x", "/x?…", "/q?" + "&".join(f"k{i}" for i in range(8))]
    names = ['attachment; filename="re port.pdf"', "inline; FILENAME*=UTF-8''a.bin; x", "inline"]
    out = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.download_name(F.col("n"))).collect()]
    assert out == ["re port.pdf", "a.bin", ""]


def _ipv4(proto, src, dst, body):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, ipaddress.ip_address(src).packed,
                       ipaddress.ip_address(dst).packed) + body


def _udp(sport, dport, body):
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


def _tcp(sport, dport, body):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, 0x18, 0, 0, 0) + body


def _ether(ip, kind=b"\x08\x00"):
    return b"\0" * 12 + kind + ip


def _hello(name):
    sni = name.encode()
    entry = struct.pack(">HBH", len(sni) + 3, 0, len(sni)) + sni
    ext = struct.pack(">HH", 0, len(entry)) + entry
    body = b"\x03\x03" + b"\0" * 32 + b"\0" + struct.pack(">H", 2) + b"\x13\x01" + b"\x01\0" + struct.pack(">H", len(ext)) + ext
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


def _frames():
    dns = struct.pack(">HHHHHH", 1, 0x0100, 1, 0, 0, 0) + b"\x03www\x07example\x03org\0" + struct.pack(">HH", 1, 1)
    get = b"GET /login?user=me&password=secret HTTP/1.1\r\nHost: shop.example\r\nContent-Type: text/html\r\n\r\nbody: x"
    reply = b"HTTP/1.1 200 OK\r\nContent-Disposition: attachment; filename=\"a b.zip\"\r\nContent-Type: application/zip\r\n\r\nPK"
    v6 = struct.pack(">IHBB", 0x60000000, 8, 58, 64) + ipaddress.ip_address("fe80::1").packed + ipaddress.ip_address("ff02::1").packed + b"\0" * 8
    return [_ether(_ipv4(17, "192.168.1.5", "8.8.8.8", _udp(5000, 53, dns))),
            _ether(_ipv4(6, "192.168.1.5", "1.2.3.4", _tcp(5001, 80, get))),
            _ether(_ipv4(6, "1.2.3.4", "192.168.1.5", _tcp(80, 5001, reply))),
            _ether(_ipv4(6, "192.168.1.5", "5.6.7.8", _tcp(5002, 443, _hello("secure.example")))),
            _ether(v6, b"\x86\xdd"), _ether(b"\0" * 28, b"\x08\x06"),
            b"\0" * 12 + b"\x81\x00\x00\x05\x08\x00" + _ipv4(6, "9.9.9.9", "7.7.7.7", _tcp(1, 22, b""))]


def _pcap(frames):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack("<IIII", 1700000000 + i, 250000, len(f), len(f)) + f
    return out


def _pcapng(frames):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for i, f in enumerate(frames):
        ticks = (1700000000 + i) * 1_000_000 + 250000
        out += block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def test_captures_of_both_kinds_give_the_same_flows(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(_pcap(_frames()))
    (tmp_path / "y.pcapng").write_bytes(_pcapng(_frames()))
    classic = capture.scan_capture(spark, str(tmp_path / "x.pcap")).orderBy("timestamp").collect()
    blocks = capture.scan_capture(spark, str(tmp_path / "y.pcapng")).orderBy("timestamp").collect()
    assert list(map(tuple, classic)) == list(map(tuple, blocks)) and len(classic) == 6
    dns, get, reply, tls, v6, vlan = classic
    assert (dns["timestamp"], dns["user"], dns["app_category"], dns["dns_query"], dns["activity"]) == (
        datetime(2023, 11, 14, 22, 13, 20, 250000), "192.168.1.5", "DNS", "www.example.org", "dns_query")
    assert (get["url"], get["hostname"], get["activity"], get["content_type"]) == (
        "http://shop.example/login?user&password", "shop.example", "web_visit", "text/html")
    assert "secret" not in str(get)
    assert (reply["download_name"], reply["activity"], reply["activity_target"], reply["user"]) == (
        "a b.zip", "file_download", "a b.zip", "192.168.1.5")
    assert (tls["tls_sni"], tls["url"], tls["app_category"]) == ("secure.example", "https://secure.example/", "Encrypted Web")
    assert (v6["protocol"], v6["src_ip"], v6["app_category"]) == ("ICMPV6", "fe80::1", "Network Control")
    assert (vlan["protocol"], vlan["dst_port"], vlan["app_category"]) == ("TCP", 22, "Remote Access")
    counts = capture.skipped_frames(spark, str(tmp_path / "x.pcap")).first()
    assert (counts["records"], counts["skipped"]) == (6, 1)


def test_process_lookup_order(spark, make_flows):
    flows = make_flows(
        {"src_ip": "a", "src_port": 1, "dst_ip": "b", "dst_port": 2}, {"src_ip": "b", "src_port": 2, "dst_ip": "a", "dst_port": 1},
        {"src_ip": "a", "src_port": 1, "dst_ip": "z", "dst_port": 9}, {"src_ip": "y", "src_port": 8, "dst_ip": "a", "dst_port": 1},
        {"src_ip": "a", "src_port": 1, "dst_ip": "b", "dst_port": 2, "protocol": "ICMP"}, {"src_ip": "q", "dst_ip": "r"})
    sockets = spark.createDataFrame([("a", 1, "b", 2, "TCP", "exact", 70001), ("a", 1, "", 0, "TCP", "local", 90000)],
                                    "local_ip string, local_port int, remote_ip string, remote_port int, protocol string, process_name string, process_id int")
    out = N.attribute_process(flows, sockets).orderBy("flow_id").collect()
    assert [(r["process_name"], r["process_id"]) for r in out] == [
        ("exact", 70001), ("exact", 70001), ("local", 90000), ("local", 90000), ("", 0), ("", 0)]


def test_quality_rules_on_files(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text(HEADER + _line("a", "-3") + _line("b", "x") + "1,2\n" + _line("c"))
    issues = {(r["row"], r["rule"], r["value"]) for r in csvfiles.scan_quality(spark, str(path)).collect()}
    assert issues == {(1, "total_rows", "4"), (2, "negative_bytes", "-3"), (3, "invalid_bytes", "x"), (4, "field_count", "1,2")}
    (tmp_path / "m.csv").write_text("timestamp,bytes\n1,2\n")
    missing = {r["value"] for r in csvfiles.scan_quality(spark, str(tmp_path / "m.csv")).collect() if r["rule"] == "missing_column"}
    assert missing == set(S.BASE_COLUMNS) - {"timestamp", "bytes"}


def test_row_numbers_over_many_blocks_and_keys_of_equal_rows(spark, tmp_path):
    lines = [_line(f"u{i}", "-1" if i % 97 == 0 else "5") for i in range(3000)]
    for day in ("day1", "day2"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "f.csv").write_text(HEADER + "".join(lines))
    (tmp_path / "day2" / "short.csv").write_text(HEADER.rstrip())
    paths, keys = [str(tmp_path / "day1"), str(tmp_path / "day2")], ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("16k", "1k")):
            spark.conf.set(k, v)
        found = csvfiles.scan_quality(spark, paths)
        assert spark.read.csv(paths).rdd.getNumPartitions() > 20
        rows = {(r["source_path"].split("/")[-2], r["row"]) for r in found.where("rule = 'negative_bytes'").collect()}
        assert rows == {(d, i + 2) for d in ("day1", "day2") for i in range(0, 3000, 97)}
        assert sorted(r["value"] for r in found.where("rule = 'total_rows'").collect()) == ["3000", "3000"]
        tables = [str(tmp_path / f"t{i}") for i in range(2)]
        for path in paths:
            jobs.ingest(spark, path, tables[0], NOW)
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    for path in paths:  # read in other splits
        jobs.ingest(spark, path, tables[1], NOW)
    small, large = ({(r["flow_id"], r["user"]) for r in csvfiles.read_flows(spark, t).select("flow_id", "user").collect()} for t in tables)
    assert small == large and len(small) == 6000 and len({k for k, _ in small}) == 6000


def test_epoch_unit_of_csv_files(spark, tmp_path):
    path, table, other = tmp_path / "e.csv", str(tmp_path / "t"), str(tmp_path / "o")
    path.write_text(HEADER + _line("a").replace("2024-01-01 10:00:00", "1704103200500") + _line("b").replace("2024-01-01 10:00:00", "soon"))
    want = {("a", datetime(2024, 1, 1, 10, 0, 0, 500000)), ("b", datetime(2024, 2, 1))}
    assert {(r["user"], r["timestamp"]) for r in jobs.ingest(spark, str(path), table, NOW, "ms").collect()} == want
    csvfiles.import_csv(spark, str(path), other, NOW, "ms")
    assert {(r["user"], r["timestamp"]) for r in csvfiles.read_flows(spark, other).collect()} == want
    issues = lambda name, unit: {(r["rule"], r["value"]) for r in csvfiles.scan_quality(
        spark, str(name), unit).where("rule <> 'total_rows'").collect()}
    assert issues(path, "ms") == {("replaced_time", "soon")}
    assert issues(path, "s") == {("replaced_time", "soon"), ("replaced_time", "1704103200500")}
    (tmp_path / "n.csv").write_text("timestamp,ip.src,ip.dst\n1704103200500,10.0.0.1,8.8.8.8\n")
    assert ("replaced_time", "1704103200500") in issues(tmp_path / "n.csv", "s")


def test_history_append_find_page_and_retention(spark, tmp_path, make_flows):
    path = str(tmp_path / "reports")
    for day in (1, 5, 5, 9):
        jobs.import_case(spark, make_flows({}, {"user": "v"}), f"f{day}.csv", path, datetime(2024, 1, day, 6 * (day == 5) + 1))
    frame = history.read_history(spark, path)
    assert [r["id"] for r in history.list_reports(frame, 2, 1).collect()] == [3, 2]
    body = history.find_report(frame, 1, "row_count bigint, unique_users bigint").first()["data"]
    assert (body["row_count"], body["unique_users"]) == (2, 2)
    assert history.find_report(frame, 99).count() == 0
    assert history.drop_expired(spark, path, datetime(2024, 1, 10, 12), days=5) == 3
    assert [r["id"] for r in history.read_history(spark, path).collect()] == [4]

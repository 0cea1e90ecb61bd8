import io
import random
import struct
from datetime import datetime

import pytest

from flowloom.plans import jobs
from flowloom.sources import capture, framing
from flowloom.sources.canonical import ImportFailure
from tests.test_sources import _ether, _frames, _hello, _ipv4, _pcap, _pcapng, _tcp, _udp


def _many(n, seed=1, size=200):
    rnd = random.Random(seed)
    return [_ether(_ipv4(17, f"192.168.1.{i % 200}", "8.8.8.8", _udp(1000 + i % 60000, 443, rnd.randbytes(rnd.randrange(size))))) for i in range(n)]


def _classic(frames, order="<", nano=False, snap=262144):
    out = [struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, snap, 1)]
    for i, f in enumerate(frames):
        out.append(struct.pack(order + "IIII", 1700000000 + i, 250_000_000 if nano else 250_000, len(f), len(f) + i % 3) + f)
    return out


def _block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    size = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", kind) + size + body + size


def _sections(frames, orders):
    """A block file whose every section has two interfaces, the second one introduced in its middle."""
    out, each = [], len(frames) // len(orders)
    for s, order in enumerate(orders):
        out.append(_block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order))
        out.append(_block(1, struct.pack(order + "HHI", 1, 0, 65535), order))
        for i in range(each):
            if i == each // 2:  # nanoseconds
                out.append(_block(1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3xHH", 9, 1, 9, 0, 0), order))
            f, face = frames[s * each + i], int(i >= each // 2 and i % 2)
            ticks = (1700000000 + s * each + i) * (10 ** 9 if face else 10 ** 6)
            out.append(_block(6, struct.pack(order + "IIIII", face, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f, order))
    return out


def _read(data, step):
    """Frames read range by range, each range by a reader of its own."""
    late = [link for at in range(0, len(data), step)
            for link in framing.late_links(framing.open_capture(io.BytesIO(data), len(data)), at, min(at + step, len(data)))]
    if step < len(data):  # late interfaces are first looked for without knowing the earlier ones
        whole = list(framing.late_links(framing.open_capture(io.BytesIO(data), len(data)), 0, len(data)))
        assert late == whole
    return [f for at in range(0, len(data), step)
            for f in framing.frames(framing.open_capture(io.BytesIO(data), len(data), late), at, min(at + step, len(data)))]


@pytest.fixture
def near(monkeypatch):
    """Readers look back a few hundred bytes instead of half a megabyte, so small files are really entered in the middle."""
    monkeypatch.setattr(framing, "LONGEST", 400)
    monkeypatch.setattr(framing, "CHUNK", 2048)


@pytest.mark.parametrize("order, nano", [("<", False), (">", True)])
def test_ranges_of_classic_files_equal_one_walk(near, order, nano):
    frames = _many(300)
    data = b"".join(_classic(frames, order, nano, 300))
    whole = _read(data, len(data))
    assert [f.data for f in whole] == frames and [f.ts_us for f in whole] == [(1700000000 + i) * 1_000_000 + 250_000 for i in range(300)]
    for step in (1024, 1000, 77, 5001):
        assert _read(data, step) == whole


def test_ranges_of_block_files_equal_one_walk(near, monkeypatch):
    monkeypatch.setattr(framing, "LONGEST", 100)
    frames = _many(400)
    data = b"".join(_sections(frames, "<"))
    whole = _read(data, len(data))
    assert [f.data for f in whole] == frames
    assert [f.ts_us for f in whole] == [(1700000000 + i) * 1_000_000 for i in range(400)]
    for step in (1024, 4096, 10_000):
        assert _read(data, step) == whole
    mixed = b"".join(_sections(frames, "<><"))
    assert [f.data for f in _read(mixed, len(mixed))] == frames[:399]


def test_captures_inside_captures_do_not_mislead(near, monkeypatch):
    monkeypatch.setattr(framing, "LONGEST", 3000)
    inner = b"".join(_classic(_many(2000, 2, 60)))[24:]
    frames = [_ether(_ipv4(6, "192.168.1.5", "1.2.3.4", _tcp(5001, 80, inner[i:i + 1400]))) for i in range(0, len(inner), 1400)]
    data = b"".join(_classic(frames, snap=2000))
    assert [f.data for f in _read(data, 1024)] == frames


def test_bad_lengths_and_cuts_are_listed_and_passed_over(near):
    frames = _many(200)
    parts = _classic(frames, snap=300)
    place = sum(map(len, parts[:50]))
    broken = bytearray(b"".join(parts))
    broken[place + 8:place + 12] = struct.pack("<I", 0x7FFFFFFF)
    broken = bytes(broken[:-10])  # and the last record is cut
    whole = _read(broken, len(broken))
    assert [(f.offset, f.issue) for f in whole if f.issue] == [(place, "truncated"), (len(broken) - len(parts[-1]) + 10, "truncated")]
    assert [f.data for f in whole if not f.issue] == frames[:49] + frames[50:199]
    for step in (1024, 333):
        assert _read(broken, step) == whole
    blocks = _sections(frames, "<")
    at = sum(map(len, blocks[:60]))
    bad = bytearray(b"".join(blocks))
    bad[at + 4:at + 8] = b"\xff\xff\xff\x7f"
    got = _read(bytes(bad), len(bad))
    assert [(f.offset, f.issue) for f in got if f.issue] == [(at, "truncated")] and len(got) == 200
    assert _read(bytes(bad), 2048) == got


def test_small_ranges_in_spark_equal_whole_files(spark, tmp_path, near):
    frames = _frames() * 40
    (tmp_path / "a.pcap").write_bytes(_pcap(frames))
    (tmp_path / "b.pcapng").write_bytes(_pcapng(frames) + b"\x06\0\0\0cut")
    (tmp_path / "_left_out.pcap").write_bytes(b"x")
    path = str(tmp_path)
    whole = capture.scan_packets(spark, path)
    parts = capture.scan_packets(spark, path, 1024)
    assert parts.rdd.getNumPartitions() > 30
    order = ["source_path", "offset"]
    assert parts.orderBy(order).collect() == whole.orderBy(order).collect()
    assert whole.where("issue = 'truncated'").count() == 1 and whole.where("issue is null").count() == 560
    report = {r["name"]: r for r in capture.capture_report(spark, path, 4096).collect()}
    assert {n: (r["type"], r["records"], r["skipped"], r["issues"], r["ok"]) for n, r in report.items()} == {
        "a.pcap": ("PCAP", 240, 40, 0, True), "b.pcapng": ("PCAPNG", 240, 40, 1, True)}
    assert report["b.pcapng"]["warnings"] == ["skipped 40 frames without IP", "1 places could not be read"]
    # The form for stores that only Spark reads gives the same rows.
    files = spark.read.format("binaryFile").load(path + "/a.pcap").selectExpr("_metadata.file_name source_file", "'p' source_path", "content")
    other = files.mapInArrow(capture._whole("packets"), capture.PACKET_SCHEMA).drop("source_path").orderBy("offset").collect()
    assert other == whole.where("source_file = 'a.pcap'").drop("source_path").orderBy("offset").collect()


def test_captures_without_packets_or_of_another_kind(spark, tmp_path):
    (tmp_path / "none.pcap").write_bytes(_pcap([_ether(b"\0" * 28, b"\x08\x06")]))
    with pytest.raises(ImportFailure, match="no IP packets in .*none.pcap"):
        capture.import_capture(spark, str(tmp_path / "none.pcap"))
    (tmp_path / "text.pcap").write_bytes(b"plain text")
    with pytest.raises(Exception, match="no packet capture"):
        capture.scan_packets(spark, str(tmp_path / "text.pcap")).collect()
    with pytest.raises(Exception, match="no file at"):
        capture.scan_packets(spark, str(tmp_path / "absent.pcap")).collect()


def test_ingest_keys_tell_captures_apart(spark, tmp_path):
    table = str(tmp_path / "t")
    for day in ("day1", "day2"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "x.pcap").write_bytes(_pcap(_frames()))
        jobs.ingest(spark, str(tmp_path / day / "*.pcap"), table, datetime(2024, 1, 1))
    ids = [r["flow_id"] for r in spark.read.parquet(table).collect()]
    assert len(ids) == len(set(ids)) == 12
    jobs.ingest(spark, str(tmp_path / "day1" / "x.pcap"), table, datetime(2025, 1, 1))
    assert {r["flow_id"] for r in spark.read.parquet(table).collect()} == set(ids)


def _client(extensions, session=b"", split=None):
    body = b"\x03\x03" + b"\0" * 32 + bytes([len(session)]) + session + b"\0\x02\x13\x01\x01\0" + extensions
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    pieces = [shake] if split is None else [shake[:split], shake[split:]]
    return b"".join(b"\x16\x03\x01" + struct.pack(">H", len(p)) + p for p in pieces)


def _names(*entries):
    listed = b"".join(bytes([kind]) + struct.pack(">H", len(n)) + n for kind, n in entries)
    data = struct.pack(">H", len(listed)) + listed
    return struct.pack(">HH", 0, len(data)) + data


def _whole(*extensions):
    return struct.pack(">H", sum(map(len, extensions))) + b"".join(extensions)


def test_server_names_of_client_hellos():
    other = struct.pack(">HH", 10, 4) + b"\0\x02\0\x1d"
    assert capture.server_names(_hello("secure.example")) == [b"secure.example"]
    assert capture.server_names(_client(_whole(other, _names((0, b"a.example"))), b"s" * 32)) == [b"a.example"]
    two = _client(_whole(_names((7, b"skip"), (0, b"one.example"), (0, b"two.example")), other))
    assert capture.server_names(two) == [b"one.example", b"two.example"]
    assert capture.server_names(_client(_whole(_names((0, b"a.example"))), split=30)) == [b"a.example"]  # two records
    assert capture.server_names(_client(b"")) == [] and len(_client(b"")) < 52  # no extensions at all
    hello = _client(_whole(_names((0, b"a.example")), struct.pack(">HH", 21, 900) + b"\0" * 900))
    assert capture.server_names(hello[:200]) == [b"a.example"]  # cut behind the name by the packet's end
    start = hello.index(b"a.example")
    assert capture.server_names(hello[:start + 4]) == []  # cut inside the name
    broken = bytearray(hello)
    broken[start - 2:start] = b"\xff\xff"
    assert capture.server_names(bytes(broken)) == []
    for raw in (b"", b"\x16", b"\x17" + hello[1:], hello[:5] + b"\x02" + hello[6:], bytes(100)):
        assert capture.server_names(raw) == []
    for n in range(len(hello)):
        assert capture.server_names(hello[:n]) in ([], [b"a.example"])


def test_short_hello_reaches_the_flow(spark, tmp_path):
    hello = _client(_whole(_names((0, b"a.b"))))
    assert capture.tls_server_name.func(__import__("pandas").Series([hello, b"", None, _client(_whole(_names((0, b"\xff.x"), (0, b"b.c"))))])).tolist() == [
        "a.b", "", "", "b.c"]
    (tmp_path / "s.pcap").write_bytes(_pcap([_ether(_ipv4(6, "192.168.1.5", "5.6.7.8", _tcp(5002, 443, hello)))]))
    assert capture.scan_capture(spark, str(tmp_path / "s.pcap")).first()["tls_sni"] == "a.b"

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowloom.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                                    "spark.sql.streaming.metricsEnabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    return SMALL


FLOW = ("flow_id bigint, timestamp timestamp_ntz, src_ip string, dst_ip string, src_port int, dst_port int, "
        "protocol string, bytes bigint, app_category string, user string, payload string")


@pytest.fixture(scope="session")
def make_flows(spark):
    """Flow rows from dicts; missing fields get plain defaults."""
    from datetime import datetime

    base = {"timestamp": "2024-01-03 12:00:00", "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8", "src_port": 40000,
            "dst_port": 443, "protocol": "TCP", "bytes": 100, "app_category": "Other", "user": "u", "payload": ""}

    def build(*rows):
        out = []
        for i, row in enumerate(rows):
            full = {"flow_id": i, **base, **row}
            full["timestamp"] = datetime.fromisoformat(full["timestamp"])
            out.append(tuple(full[c.split()[0]] for c in FLOW.split(", ")))
        return spark.createDataFrame(out, FLOW)

    return build

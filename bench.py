"""Headline timings on the flow view of $BENCH_SF_DIR; prints one JSON line.

The flow view is written once as the partitioned flow table, as a user would have it, and the
queries read that table. Every query is run to completion and its rows are collected or, for
row-level results, written to the no-op sink. Each query runs twice: ``queries`` holds the second
run (a session that is already up, like the running service it is compared with), ``cold`` the
first.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowloom.operators import adhoc as H  # noqa: E402
from flowloom.operators import profile as C  # noqa: E402
from flowloom.operators import rules as R  # noqa: E402
from flowloom.operators import tags as D  # noqa: E402
from flowloom.operators import traffic as B  # noqa: E402
from flowloom.operators.anomaly import ensemble as M  # noqa: E402
from flowloom.operators.anomaly import features as U  # noqa: E402
from flowloom.plans import jobs  # noqa: E402
from flowloom.session import build_session  # noqa: E402
from flowloom.sources import csvfiles  # noqa: E402
from flowloom.sources import sample_views as V  # noqa: E402
from flowloom.streaming import live as G  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="flowloom-bench-")
    table, csv = f"{work}/flows", f"{work}/csv"
    times: dict[str, float] = {}
    cold: dict[str, float] = {}

    def timed(name, action):
        for record in (cold, times):
            start = time.perf_counter()
            action()
            record[name] = round(time.perf_counter() - start, 3)

    def noop(frame):
        frame.write.format("noop").mode("overwrite").save()

    spark.range(10).count()
    timed("write_flow_table", lambda: csvfiles.write_flows(V.flows(spark, sf_dir), table, "overwrite"))
    V.flows(spark, sf_dir).drop("payload").write.option("header", True).csv(csv)
    flows = spark.read.parquet(table)
    rows = flows.count()
    # Alerts and outliers have timings of their own; the dashboard reads their tables.
    outliers = jobs.anomaly_report(flows, f"{work}/outliers")
    runs = {
        "csv_load": lambda: noop(csvfiles.scan_csv(spark, csv, "2024-02-01 00:00:00")),
        "basic_stats": lambda: B.totals(flows).collect(),
        "top_users": lambda: B.top_users(flows).collect(),
        "traffic_trend": lambda: B.trend(flows).collect(),
        "anomaly_timeline": lambda: B.anomaly_timeline(flows).collect(),
        "detailed_stats": lambda: H.detailed_stats(flows).collect(),
        "topology": lambda: noop(H.topology_edges(flows)),
        "search": lambda: H.search_totals(flows, "game").collect(),
        "user_tags": lambda: noop(D.user_tags(flows)),
        "user_profiles": lambda: noop(C.profiles(flows)),
        "reconnaissance": lambda: noop(R.reconnaissance(flows)),
        "beaconing": lambda: noop(R.beaconing(flows)),
        "scan_windows": lambda: noop(G.port_scan_windows(flows)),
        "security_report": lambda: jobs.security_report(flows, f"{work}/security"),
        "dashboard": lambda: jobs.dashboard(flows, f"{work}/dash", spark.read.parquet(f"{work}/security/alerts"), outliers),
        "features": lambda: noop(U.feature_table(flows)),
        "isolation_forest": lambda: M.model_report(flows, "isolation_forest")["anomalies"].collect(),
        "local_outlier_factor": lambda: M.model_report(flows, "local_outlier_factor")["anomalies"].collect(),
    }
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    for name, action in runs.items():
        if not only or name in only:
            timed(name, action)
    print(json.dumps({"metric": "flow analytics total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": rows}))


if __name__ == "__main__":
    main()

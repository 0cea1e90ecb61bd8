"""Batch entry points: each job writes its tables once and reads the written tables on.

Nothing is pinned in executor memory: an intermediate that several results need is a Parquet
table, so a lost executor costs a re-read and not a re-run of the whole job.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import adhoc as H
from flowloom.operators import profile as C
from flowloom.operators import rules as R
from flowloom.operators import traffic as B
from flowloom.operators.anomaly import ensemble as M
from flowloom.operators.anomaly import features as U
from flowloom.session import durable, scratch
from flowloom.sources import capture, csvfiles, history, rownumbers


def store(frame: DataFrame, path: str) -> DataFrame:
    """Write a result table and return it as read back."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.parquet(path)


def ingest(spark: SparkSession, path: str, table: str, ingest_ts: str | datetime, time_unit: str = "s") -> DataFrame:
    """CSV or capture files into the flow table partitioned by date, with a repeatable ``flow_id`` from file and place.

    The numbers of the files stand in ``<table>_files``.

    ``time_unit`` is what epoch numbers of CSV files count; ``csvfiles.scan_quality`` lists the times that were replaced.
    """
    kind = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    if kind in ("pcap", "pcapng", "cap"):
        flows, _ = capture.import_capture(spark, path)
    elif kind == "csv" or "." not in path.rsplit("/", 1)[-1]:
        flows = csvfiles.scan_csv(spark, path, ingest_ts, with_file=True, time_unit=time_unit)
    else:
        raise csvfiles.ImportFailure("only csv, pcap, pcapng and cap files can be read")
    keyed = rownumbers.with_flow_id(flows, f"{table.rstrip('/')}_files", place="offset" if "offset" in flows.columns else "row")
    csvfiles.write_flows(keyed.drop("source_file", "source_path", "offset", "row"), table)
    return csvfiles.read_flows(spark, table)


def security_report(flows: DataFrame, out: str) -> dict[str, DataFrame]:
    """Alerts are evaluated once; ids, block list and summary come from the stored alerts."""
    with scratch(flows.sparkSession):
        alerts = store(R.with_alert_ids(R.all_alerts(flows)), f"{out}/alerts")
    return {"alerts": alerts, "block_list": store(R.block_list(alerts), f"{out}/block_list"),
            "summary": store(R.risk_summary(alerts), f"{out}/risk_summary")}


def anomaly_report(flows: DataFrame, out: str, model: str = "isolation_forest", top_n: int = U.TOP_N) -> dict[str, DataFrame]:
    with scratch(flows.sparkSession):
        frames = M.model_report(flows, model, top_n)
        return {name: store(frame, f"{out}/{model}_{name}") for name, frame in frames.items()}


def dashboard(flows: DataFrame, out: str, alerts: DataFrame | None = None, outliers: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Totals, top 15 users, categories, hours, activity, attack sources and outliers as small stored tables.

    ``alerts`` and ``outliers`` (summary and anomalies of a model report) are made here unless they are at hand.
    """
    if outliers is None:
        outliers = anomaly_report(flows, out)
    alerts = alerts if alerts is not None else security_report(flows, out)["alerts"]
    parts = {
        "total_traffic": B.totals(flows), "user_ranking": B.top_users(flows, 15), "app_category": B.category_bytes(flows),
        "active_hours": B.active_hours(flows), "attack_sources": R.attack_sources(flows, R.block_list(alerts)),
        "outlier_summary": outliers["summary"], "outliers": outliers["anomalies"],
    }
    if "hostname" in flows.columns:
        parts["activity_summary"] = B.activity_summary(flows)
    return {name: store(frame, f"{out}/{name}") for name, frame in parts.items()}


def overall_summary(flows: DataFrame, alerts: DataFrame, scored: DataFrame) -> DataFrame:
    """Totals with top users, categories, hours, and alert and anomaly counts in long form."""
    def long(section: str, frame: DataFrame, name: str, amount: str) -> DataFrame:
        return frame.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"),
                            F.col(amount).cast("bigint").alias("amount"))

    totals = B.totals(flows)
    single = totals.select(F.inline(F.array(*[
        F.struct(F.lit("total").alias("section"), F.lit(c).alias("name"), F.col(c).cast("bigint").alias("amount"))
        for c in totals.columns])))
    counts = [frame.agg(F.count(F.lit(1)).alias("amount")).select(F.lit("count").alias("section"), F.lit(name).alias("name"), "amount")
              for name, frame in (("alerts", alerts), ("anomalies", scored.where("is_anomaly")))]
    out = single
    for part in (long("user", B.top_users(flows, 5), "user", "bytes"), long("category", B.category_bytes(flows), "app_category", "bytes"),
                 long("hour", B.active_hours(flows), "hour", "total_bytes"), *counts):
        out = out.unionByName(part)
    return out


def busiest_hours(flows: DataFrame, top_n: int = 5) -> DataFrame:
    return B.active_hours(flows).orderBy(F.col("total_bytes").desc(), "hour").limit(top_n)


def full_analysis(flows: DataFrame, out: str) -> dict[str, DataFrame]:
    """All analyses of one flow table, each written below ``out``."""
    results = {
        "totals": store(B.totals(flows), f"{out}/totals"),
        "top_users": store(B.top_users(flows, 10), f"{out}/top_users"),
        "categories": store(B.category_bytes(flows), f"{out}/categories"),
        "busiest_hours": store(busiest_hours(flows), f"{out}/busiest_hours"),
        "profiles": store(C.profiles(flows), f"{out}/profiles"),
    }
    results.update(security_report(flows, out))
    results.update({f"anomaly_{k}": v for k, v in anomaly_report(flows, out).items()})
    return results


def import_case(spark: SparkSession, flows: DataFrame, name: str, reports: str, created_at: datetime) -> int:
    """Summary of one imported flow table appended to the report history."""
    return history.append_report(spark, reports, name, H.data_info(flows), created_at)


def batch_of_files(spark: SparkSession, path: str, ingest_ts: str | datetime) -> DataFrame:
    """Record count and totals per CSV file of a folder, in one job."""
    flows = csvfiles.scan_csv(spark, path, ingest_ts, with_file=True)
    return flows.groupBy(F.col("source_file").alias("file")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("total_bytes"), F.countDistinct("user").alias("unique_users"))


def summary_query(flows: DataFrame) -> DataFrame:
    """Overall summary from flows alone; alerts and scores are checkpointed, not recomputed."""
    alerts = durable(R.all_alerts(flows))
    _, vectors, users = M.prepare(flows)
    scored = durable(M.detect(vectors, users, "isolation_forest"))
    return overall_summary(flows, alerts, scored)

"""Live view of a flow stream: totals, five-second buckets, alerts, and their batch twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from flowloom import schema as S
from flowloom.functions import scalars as X
from flowloom.operators.common import rows, sum_bytes
from flowloom.operators.traffic import recent_downloads, top_text
from flowloom.streaming.increments import IncrementTable
from flowloom.streaming.scans import ALERT_FIELDS, LATE, port_scan_alerts, scan_events, scan_step  # noqa: F401

WATERMARK = "30 seconds"


def live_schema() -> T.StructType:
    """Event time has a zone here: watermarks do not accept zone-free timestamps."""
    fields = [T.StructField("flow_id", T.LongType())]
    fields += [T.StructField(f.name, T.TimestampType() if f.name == "timestamp" else f.dataType)
               for f in S.CANONICAL_SCHEMA.fields[:len(S.BASE_COLUMNS)]]
    return T.StructType(fields)


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Flow files as a stream, in arrival order; the trigger sets the pace."""
    return (spark.readStream.schema(live_schema()).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


_TOTALS = ("events", "total_bytes", "unique_users", "unique_src_ips", "alerts", "last_event_at")


def running_totals(events: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Totals of a table of flows, exact: events, bytes, users, source addresses, alerts, time of the last event.

    Alerts are large flows, sensitive ports and scans; ``scans`` are the scan alerts if already at hand.
    """
    alerts = F.count_if(F.col("bytes") >= S.LIVE_LARGE_FLOW_BYTES) + F.count_if(F.col("dst_port").isin(S.SUSPICIOUS_PORTS))
    fired = (port_scan_alerts(events) if scans is None else scans).agg(rows("n")).scalar()
    return events.agg(rows("events"), sum_bytes(name="total_bytes"), F.countDistinct("user").alias("unique_users"),
                      F.countDistinct("src_ip").alias("unique_src_ips"), alerts.alias("alerts"),
                      F.max("timestamp").alias("last_event_at")).withColumn("alerts", F.col("alerts") + fired).select(*_TOTALS)


def _total_parts(batch: DataFrame) -> DataFrame:
    """Totals of one micro-batch: sums, and one sketch of fixed size for each distinct count."""
    alerts = F.count_if(F.col("bytes") >= S.LIVE_LARGE_FLOW_BYTES) + F.count_if(F.col("dst_port").isin(S.SUSPICIOUS_PORTS))
    return batch.agg(rows("events"), sum_bytes(name="total_bytes"), F.hll_sketch_agg("user", 14).alias("users"),
                     F.hll_sketch_agg("src_ip", 14).alias("src_ips"), alerts.alias("alerts"), F.max("timestamp").alias("last_event_at"))


def _merged_totals(parts: DataFrame) -> DataFrame:
    return parts.agg(*(F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in ("events", "total_bytes")),
                     *(F.hll_union_agg(c).alias(c) for c in ("users", "src_ips")), F.coalesce(F.sum("alerts"), F.lit(0).cast("bigint")).alias("alerts"),
                     F.max("last_event_at").alias("last_event_at"))


def total_increments(spark: SparkSession, table: str) -> IncrementTable:
    """Running totals of a stream. Distinct counts are sketches (standard error 0.8 %), the rest is exact; the alerts are the
    stateless ones, scan alerts stand in their own table."""
    return IncrementTable(spark, table, _total_parts, _merged_totals)


def read_totals(table: IncrementTable, scans: DataFrame | None = None) -> DataFrame:
    """The six totals as of the last finished batch; ``scans`` are the stream's scan alerts."""
    fired = F.lit(0).cast("bigint") if scans is None else scans.where(F.col("title") == "port_scan").agg(rows("n")).scalar()
    return table.read().select("events", "total_bytes", F.hll_sketch_estimate("users").alias("unique_users"),
                               F.hll_sketch_estimate("src_ips").alias("unique_src_ips"), (F.col("alerts") + fired).alias("alerts"), "last_event_at")


def second_increments(spark: SparkSession, table: str) -> IncrementTable:
    """Bytes and events per second of event time, kept from a stream: buckets and rates are read from it, late events included."""
    def partial(batch: DataFrame) -> DataFrame:
        return batch.where("timestamp is not null").groupBy(F.date_trunc("second", "timestamp").alias("second")).agg(sum_bytes(), rows("events"))

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy("second").agg(F.sum("bytes").alias("bytes"), F.sum("events").alias("events"))

    return IncrementTable(spark, table, partial, merge)


def read_buckets(table: IncrementTable) -> DataFrame:
    """Five-second buckets of a stream's seconds."""
    return table.read().groupBy(F.window("second", f"{S.LIVE_BUCKET_SECONDS} seconds").alias("w")).agg(
        F.sum("bytes").alias("bytes"), F.sum("events").alias("events")).select(F.col("w.start").alias("ts"), "bytes", "events")


def read_rate(table: IncrementTable) -> DataFrame:
    """Events per second over five seconds, each second, of a stream's seconds."""
    return table.read().groupBy(F.window("second", "5 seconds", "1 second").alias("w")).agg(F.sum("events").alias("n")).select(
        F.col("w.end").alias("ts"), (F.col("n").cast("double") / 5.0).alias("events_per_second"))


def traffic_buckets(events: DataFrame) -> DataFrame:
    """Bytes and events per five seconds of a table; a stream keeps them through :func:`second_increments`."""
    seconds = f"{S.LIVE_BUCKET_SECONDS} seconds"
    return (events.groupBy(F.window("timestamp", seconds).alias("w"))
            .agg(sum_bytes(), rows("events")).select(F.col("w.start").alias("ts"), "bytes", "events"))


def latest_buckets(buckets: DataFrame, kept: int = S.LIVE_BUCKETS_KEPT) -> DataFrame:
    """The newest ``kept`` five-second buckets of a bucket table, empty ones as zero.

    One aggregate builds the fixed list of bucket times; the table is then looked up in a map of
    at most ``kept`` entries.
    """
    step = S.LIVE_BUCKET_SECONDS
    second = F.unix_timestamp(F.col("ts"))
    newest = buckets.agg(F.max(second).alias("m")).scalar()
    recent = buckets.where(second > newest - kept * step)
    seen = recent.agg(F.map_from_entries(F.collect_list(F.struct(second, F.struct("bytes", "events")))).alias("seen"),
                      F.min(second).alias("oldest"), F.max(second).alias("newest"))
    spread = seen.where(F.col("newest").isNotNull()).select(
        "seen", F.explode(F.sequence(F.col("oldest"), F.col("newest"), F.lit(step))).alias("s"))
    hit = F.try_element_at("seen", F.col("s"))
    zero = F.lit(0).cast("bigint")
    return spread.select(F.timestamp_seconds("s").alias("ts"), F.coalesce(hit["bytes"], zero).alias("bytes"),
                         F.coalesce(hit["events"], zero).alias("events"))


def event_rate(events: DataFrame) -> DataFrame:
    """Events per second over a five-second window sliding by one second, of a table; for a stream see :func:`read_rate`."""
    return (events.groupBy(F.window("timestamp", "5 seconds", "1 second").alias("w")).agg(rows("n"))
            .select(F.col("w.end").alias("ts"), (F.col("n").cast("double") / 5.0).alias("events_per_second")))


def _alert(frame: DataFrame, level: str, title: str, entity: Column, detail: Column) -> DataFrame:
    return frame.select(F.col("timestamp").alias("ts"), F.lit(level).alias("level"), F.lit(title).alias("title"),
                        entity.alias("entity"), detail.alias("detail"))


def large_flows(events: DataFrame) -> DataFrame:
    """Single flows of at least 50 000 bytes; stateless."""
    detail = F.format_string("%d bytes to %s:%d", "bytes", "dst_ip", "dst_port")
    return _alert(events.where(F.col("bytes") >= S.LIVE_LARGE_FLOW_BYTES), "medium", "large_flow", F.col("user"), detail)


def sensitive_ports(events: DataFrame) -> DataFrame:
    """Flows to one of the suspicious ports; stateless."""
    return _alert(events.where(F.col("dst_port").isin(S.SUSPICIOUS_PORTS)), "medium", "sensitive_port",
                  F.concat_ws(" / ", "user", "src_ip"), F.format_string("port %d", "dst_port"))


def port_scans(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Scan alerts of a stream, in event order per source; see :mod:`flowloom.streaming.scans`."""
    return scan_events(events, watermark).where(F.col("title") != LATE)


def port_scan_windows(flows: DataFrame, chunk_seconds: int = 60) -> DataFrame:
    """Batch twin of the scan rule without clearing: flows with six ports in their last 30 seconds.

    A hot source is cut into time chunks; each chunk also gets the 30 seconds before it, so the
    result is whole. Inside a chunk every port covers the 30 seconds after each of its hits, and
    the number of covering ports is one running sum, however many flows there are.
    """
    reach, chunk = S.LIVE_SCAN_SECONDS * 1_000_000, chunk_seconds * 1_000_000
    timed = flows.select("flow_id", "src_ip", "dst_port", X.epoch_micros(F.col("timestamp")).alias("us")).where(
        "src_ip IS NOT NULL AND us IS NOT NULL")
    last = F.floor((F.col("us") + F.lit(reach)) / F.lit(chunk))
    # One shuffle by (source, chunk) serves every step up to the counts.
    copies = (timed.withColumn("own", F.floor(F.col("us") / F.lit(chunk)))
              .withColumn("chunk", F.explode(F.sequence(F.col("own"), last))).repartition("src_ip", "chunk")
              .groupBy("src_ip", "chunk", "us", "dst_port").agg(F.first("own").alias("own")))
    port = Window.partitionBy("src_ip", "chunk", "dst_port").orderBy("us")
    before, after = F.lag("us").over(port), F.lead("us").over(port)
    marked = copies.withColumns({"fresh": before.isNull() | (F.col("us") - before > reach),
                                 "ends": after.isNull() | (after - F.col("us") > reach)})

    def step(at: Column, delta: int, probe: bool) -> Column:
        return F.struct(at.alias("at"), F.lit(delta).alias("delta"), F.lit(probe).alias("probe"))

    # Coverage starts with the hit and ends one microsecond after its last half minute.
    steps = F.array_compact(F.array(F.when(F.col("fresh"), step(F.col("us"), 1, False)),
                                    F.when(F.col("ends"), step(F.col("us") + reach + 1, -1, False)),
                                    F.when(F.col("own") == F.col("chunk"), step(F.col("us"), 0, True))))
    changes = marked.select("src_ip", "chunk", F.inline(steps)).groupBy("src_ip", "chunk", "at").agg(
        F.sum("delta").alias("delta"), F.bool_or("probe").alias("probe"))
    run = Window.partitionBy("src_ip", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = (changes.withColumn("ports", F.sum("delta").over(run))
               .where(F.col("probe") & (F.col("ports") >= S.LIVE_SCAN_PORTS))
               .select("src_ip", F.col("at").alias("us"), "ports"))
    return timed.join(counted, ["src_ip", "us"]).select("flow_id", "src_ip", "dst_port", "ports")


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append alerts to a table partitioned by date; the checkpoint makes a restart exact."""
    dated = alerts.withColumn("date", F.to_date("ts"))
    writer = dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(
        "date").outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def alert_history(alerts: DataFrame, kept: int = S.LIVE_ALERTS_KEPT) -> DataFrame:
    """Newest alerts of the sink table, in time order."""
    newest = alerts.select(*ALERT_FIELDS).orderBy(F.col("ts").desc(), "entity", "title", "detail").limit(kept)
    return newest.orderBy("ts", "entity", "title", "detail")


def recent_events(flows: DataFrame, shown: int = 20) -> DataFrame:
    return flows.orderBy(F.col("timestamp").desc(), F.col("flow_id").desc()).limit(shown)


def _host() -> Column:
    def filled(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    return F.coalesce(filled("hostname"), filled("dns_query"), filled("tls_sni"), F.lit(""))


_SECONDS = "yyyy-MM-dd HH:mm:ss"


def session_status(flows: DataFrame) -> DataFrame:
    """Counts of categories, activities, hosts and processes, totals, the last 10 downloads and the last 20 flows, in long form.

    A download's name holds its time, file, source and type, a flow's its time, ends, protocol and user; their amount is the bytes.
    """
    def counted(section: str, column: Column, kept: int | None) -> DataFrame:
        frame = flows.withColumn("_v", column)
        if kept:
            out = top_text(frame, "_v", kept)
        else:
            out = frame.groupBy(F.col("_v").alias("value")).agg(rows("packets"))
        return out.select(F.lit(section).alias("section"), F.col("value").alias("name"), F.col("packets").alias("amount"))

    unknown = F.when(F.col("activity") != "", F.col("activity")).otherwise("unrecognised")
    ips = flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct().agg(rows("amount")).select(
        F.lit("distinct_ips").alias("section"), F.lit("").alias("name"), "amount")
    totals = flows.agg(rows("total_packets"), sum_bytes(name="total_bytes")).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("section"), F.lit("").alias("name"), F.col(c).alias("amount"))
        for c in ("total_packets", "total_bytes")])))
    parts = [counted("category", F.col("app_category"), None), counted("activity", unknown, None),
             counted("host", _host(), 10), counted("process", F.col("process_name"), 10), ips, totals,
             recent_downloads(flows, 10).select(F.lit("download").alias("section"), F.concat_ws(
                 "|", F.date_format("time", _SECONDS), "name", "source", "content_type").alias("name"), F.col("bytes").alias("amount")),
             recent_events(flows).select(F.lit("recent_flow").alias("section"), F.concat_ws(
                 "|", F.date_format("timestamp", _SECONDS), "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "user").alias("name"),
                 F.col("bytes").alias("amount"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def count_increments(spark: SparkSession, table: str, column: str) -> IncrementTable:
    """Packets and bytes per value of ``column``, kept from a stream."""
    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy(column).agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))

    return IncrementTable(spark, table, lambda batch: batch.groupBy(column).agg(rows("packets"), sum_bytes()), merge)


def stream_counts(events: DataFrame, column: str, table: str, checkpoint: str) -> StreamingQuery:
    """Keep counts per value of ``column`` as a table of mergeable increments."""
    return count_increments(events.sparkSession, table, column).start(events, checkpoint)


def read_counts(spark: SparkSession, table: str, column: str) -> DataFrame:
    return count_increments(spark, table, column).read()

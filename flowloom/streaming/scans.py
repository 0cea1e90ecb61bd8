"""The live port-scan rule: stateful on a stream, and the same rule over a table.

A source that reaches six ports within 30 seconds raises an alert and is forgotten. Both forms take the hits of
a source in event order, so the order of arrival does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from flowloom import schema as S
from flowloom.functions import scalars as X

ALERTS = "ts timestamp, level string, title string, entity string, detail string"
ALERT_FIELDS = [part.split()[0] for part in ALERTS.split(", ")]
LATE = "late_hit"
_REACH = S.LIVE_SCAN_SECONDS * 1_000_000


def scan_step(seen: list[tuple[int, int]], ts_us: int, port: int) -> tuple[list[tuple[int, int]], int]:
    """Remember one hit; return the new memory and the port count if the rule fires, else 0.

    The memory holds the last time of each port seen within 30 seconds, so it is bounded by the
    rule itself: six different ports fire and clear it.
    """
    oldest = ts_us - _REACH
    seen = [(t, p) for t, p in seen if t >= oldest and (p != port or t > ts_us)]
    if all(p != port for _, p in seen):
        seen.append((ts_us, port))
    ports = {p for _, p in seen}
    return ([], len(ports)) if len(ports) >= S.LIVE_SCAN_PORTS else (seen, 0)


def _detail(count: int) -> str:
    return f"{count} ports in {S.LIVE_SCAN_SECONDS} s"


class ScanProcessor(StatefulProcessor):
    """Per source: hits that wait for the watermark, and the last time of each remembered port.

    A hit waits until the watermark has passed it; all hits before it are known then, and the rule takes them in order. A
    hit that the watermark has already passed comes out as a ``late_hit`` row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, flow_id bigint, port int")
        self.memory = handle.getMapState("memory", "port int", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for batch in rows:
            hits = batch[["us", "flow_id", "dst_port"]]
            late = hits[hits["us"] < passed]
            if len(late):
                yield pd.DataFrame({"ts": pd.to_datetime(late["us"], unit="us"), "level": "info", "title": LATE, "entity": key[0],
                                    "detail": "port " + late["dst_port"].astype(str)})
            hits = hits[hits["us"] >= passed]
            if len(hits):
                self.waiting.appendList(list(zip(*(hits[c].tolist() for c in hits))))
                self.handle.registerTimer(int(hits["us"].min()) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Timers of one source that end together find its hits done by the first of them.
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        hits = sorted(self.waiting.get())
        due = [h for h in hits if h[0] < passed]
        if due:
            seen, fired = [(us, port) for (port,), (us,) in self.memory.iterator()], []
            for us, _, port in due:
                seen, count = scan_step(seen, us, port)
                if count:
                    fired.append((pd.Timestamp(us, unit="us"), "high", "port_scan", key[0], _detail(count)))
            self.memory.clear()
            for us, port in seen:
                self.memory.updateValue((port,), (us,))
            rest = hits[len(due):]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0] // 1000 + 1)
            else:
                self.waiting.clear()
            if seen:  # by then the memory is of no use
                self.handle.registerTimer((max(us for us, _ in seen) + _REACH) // 1000 + 1)
            if fired:
                yield pd.DataFrame(fired, columns=ALERT_FIELDS)
        elif not hits:
            useless = [port for (port,), (us,) in self.memory.iterator() if us + _REACH < passed]
            for port in useless:
                self.memory.removeKey((port,))

    def close(self) -> None:
        pass


def scan_events(events: DataFrame, watermark: str) -> DataFrame:
    """``port_scan`` alerts and ``late_hit`` rows of a flow stream; nothing that arrives is left out.

    An alert comes once the watermark has passed its hits. State: the hits of the last ``watermark`` of event time and at most
    five ports a source. Needs Spark's RocksDB state store, as ``build_session`` sets it.
    """
    # The event-time column itself stays behind: Spark would drop late rows of an operator that still has it.
    hits = events.withWatermark("timestamp", watermark).where("src_ip is not null and timestamp is not null").select(
        "src_ip", "flow_id", "dst_port", F.unix_micros("timestamp").alias("us"))
    return hits.groupBy("src_ip").transformWithStateInPandas(ScanProcessor(), ALERTS, "Append", "EventTime")


def late_counts(rows: DataFrame) -> DataFrame:
    """Hits later than the watermark per source and hour, from the rows of :func:`scan_events`."""
    return rows.where(F.col("title") == LATE).groupBy("entity", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("hits"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rule over rows that come sorted by source, stretch, time and flow id."""
    now, seen = None, []
    for batch in batches:
        found: list[tuple] = []
        for ip, stretch, us, port in zip(*(batch[c].to_pylist() for c in ("src_ip", "stretch", "us", "dst_port"))):
            if now != (ip, stretch):
                now, seen = (ip, stretch), []
            seen, count = scan_step(seen, us, port)
            if count:
                found.append((us, ip, _detail(count)))
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))],
                                         names=["us", "entity", "detail"])


def port_scan_alerts(flows: DataFrame) -> DataFrame:
    """The rule with clearing over a whole table: (ts, level, title, entity, detail).

    A source that pauses for a whole half minute is forgotten, so its hits fall into stretches that are worked on
    apart from each other. A stretch without such a pause is read in order by one task, in batches.
    """
    hits = flows.select("src_ip", "flow_id", "dst_port", X.epoch_micros(F.col("timestamp")).alias("us")).where(
        "src_ip is not null and us is not null").withColumn("slot", F.floor(F.col("us") / F.lit(_REACH)))
    slots = hits.groupBy("src_ip", "slot").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("src_ip").orderBy("slot")
    gap = F.coalesce(F.col("slot") - F.lag("slot").over(order) > 1, F.lit(True))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    stretches = slots.withColumn("new", gap.cast("int")).select("src_ip", "slot", F.sum("new").over(run).alias("stretch"))
    sorted_ = hits.join(stretches, ["src_ip", "slot"]).select("src_ip", "stretch", "us", "flow_id", "dst_port").repartition(
        "src_ip", "stretch").sortWithinPartitions("src_ip", "stretch", "us", "flow_id")
    found = sorted_.mapInArrow(_fold, "us bigint, entity string, detail string")
    kind = flows.schema["timestamp"].dataType.simpleString()
    return found.select(F.timestamp_micros("us").cast(kind).alias("ts"), F.lit("high").alias("level"), F.lit("port_scan").alias("title"),
                        "entity", "detail")

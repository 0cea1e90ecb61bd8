"""Shared aggregation shapes: keyed groups without null keys, top-k, and the two roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.functions import addresses as A
from flowloom.functions import scalars as X


def grouped(df: DataFrame, *keys: str) -> GroupedData:
    """Group by columns, leaving out rows whose key is null."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df.groupBy(*keys)


def sum_bytes(when: Column | None = None, name: str = "bytes") -> Column:
    value = F.col("bytes") if when is None else F.when(when, F.col("bytes"))
    return F.coalesce(F.sum(value), F.lit(0).cast("bigint")).alias(name)


def rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def top(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    """Largest ``n`` rows; the second key makes the cut repeatable."""
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(n)


def span_seconds(first: Column, last: Column) -> Column:
    """Seconds between two timestamps as a double, exact to the microsecond."""
    return (X.epoch_micros(last) - X.epoch_micros(first)).cast("double") / F.lit(1e6)


def user_hours(flows: DataFrame) -> DataFrame:
    """One row per user and hour of day with everything profiles, tags and features need.

    A hot user is spread over up to 24 keys here; the second step per user reads at most 24
    rows. Unused columns are pruned away by the optimizer.
    """
    ports = ", ".join(map(str, S.SUSPICIOUS_PORTS))

    def total(name: str, test: str) -> str:
        return f"coalesce(sum(CASE WHEN {test} THEN bytes END), 0L) AS {name}"

    aggs = [
        "count(1) AS n",
        "coalesce(sum(bytes), 0L) AS bytes",
        "min(timestamp) AS first_ts",
        "max(timestamp) AS last_ts",
        "bool_and(internal) AS all_internal",
        total("vpn_bytes", "dst_port = 443 AND protocol = 'UDP'"),
        "count_if(dst_port = 443) AS tls_rows",
        "count_if(dst_port = 53) AS dns_rows",
        total("dns_bytes", "dst_port = 53"),
        total("download_bytes", "dst_port >= 1024"),
        total("upload_bytes", "dst_port < 1024"),
        f"count_if(dst_port IN ({ports})) AS suspicious_rows",
        total("weekend_bytes", "weekday(timestamp) >= 5"),
        total("weekday_bytes", "weekday(timestamp) < 5"),
        "count_if(weekday(timestamp) < 5) AS weekday_rows",
    ]
    aggs += [total(f"cat_{name}", f"broad = '{name}'") for name in [*S.BROAD_CLASSES, "others"]]
    aggs += [f"count_if(dst_port = {p}) AS port_{p}_rows" for p in S.WATCHED_PORTS]
    marked = flows.where(F.col("user").isNotNull()).select(
        "user", "timestamp", "dst_port", "protocol", "bytes",
        F.hour("timestamp").alias("hour"),
        A.is_rfc1918_text(F.col("src_ip")).alias("internal"),
        F.coalesce(X.broad_class(F.col("app_category")), F.lit("others")).alias("broad"))
    return marked.groupBy("user", "hour").agg(*[F.expr(a) for a in aggs])


def endpoints(flows: DataFrame) -> DataFrame:
    """One row per (user, source, destination, port).

    The rules count distinct ports and targets on this much smaller frame; a hot user or
    source is already spread over its destinations.
    """
    return grouped(flows, "user", "src_ip", "dst_ip", "dst_port").agg(
        rows("n"), sum_bytes(), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.expr("count_if(hour(timestamp) BETWEEN 0 AND 5) AS night_rows"),
        F.expr("coalesce(sum(CASE WHEN hour(timestamp) BETWEEN 0 AND 5 THEN bytes END), 0L) AS night_bytes"))

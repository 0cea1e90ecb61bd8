"""Per-user profile metrics, computed for all users in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom import schema as S
from flowloom.functions import quantiles as Q
from flowloom.functions import scalars as X
from flowloom.operators.common import grouped, rows, span_seconds, sum_bytes, user_hours

_CLASSES = [*S.BROAD_CLASSES, "others"]


def _double(column: str) -> Column:
    return F.col(column).cast("double")


def users(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("user").isNotNull()).select("user").distinct()


def category_share(flows: DataFrame) -> DataFrame:
    """Percent of a user's bytes per broad class; only classes with bytes."""
    broad = F.coalesce(X.broad_class(F.col("app_category")), F.lit("others"))
    per_class = (flows.where(F.col("user").isNotNull() & F.col("app_category").isNotNull())
                 .groupBy("user", broad.alias("category")).agg(sum_bytes()))
    # At most eight classes per user reach the window.
    total = F.sum("bytes").over(Window.partitionBy("user"))
    return per_class.withColumn("pct", X.share_pct(F.col("bytes"), total)).where(
        (F.col("bytes") > 0)).select("user", "category", "pct")


def hourly_activity(flows: DataFrame) -> DataFrame:
    return user_hours(flows).where(F.col("hour").isNotNull()).select(
        "user", "hour", "bytes", F.col("n").alias("count"))


def protocol_share(flows: DataFrame) -> DataFrame:
    per_protocol = grouped(flows, "user", "protocol").agg(sum_bytes())
    total = F.sum("bytes").over(Window.partitionBy("user"))
    return per_protocol.select("user", "protocol", X.share_pct(F.col("bytes"), total).alias("pct"))


def encrypted_share(flows: DataFrame) -> DataFrame:
    base = user_hours(flows).groupBy("user").agg(F.sum("tls_rows").alias("tls"), F.sum("n").alias("n"))
    return base.select("user", F.col("tls").alias("encrypted_packets"),
                       (F.col("n") - F.col("tls")).alias("unencrypted_packets"),
                       X.share_pct(F.col("tls"), F.col("n")).alias("encryption_ratio"))


def connection_rate(flows: DataFrame) -> DataFrame:
    base = user_hours(flows).groupBy("user").agg(
        F.sum("n").alias("n"), F.min("first_ts").alias("a"), F.max("last_ts").alias("b"))
    hours = F.coalesce(span_seconds(F.col("a"), F.col("b")), F.lit(0.0)) / F.lit(3600.0)
    return base.withColumn("h", hours).select(
        "user",
        F.when(F.col("h") > 0, X.round_half_up(_double("n") / F.col("h"), 2)).otherwise(0.0).alias("connections_per_hour"),
        F.when(F.col("h") > 0, X.round_half_up(F.col("h"), 2)).otherwise(0.0).alias("total_hours"),
        F.col("n").alias("total_connections"))


def _peak() -> Column:
    """Busiest hour as a struct; the lowest hour wins a tie."""
    return F.max(F.struct(F.col("bytes").alias("bytes"), (-F.col("hour")).alias("neg_hour")))


def peak_bandwidth(flows: DataFrame) -> DataFrame:
    best = user_hours(flows).where(F.col("hour").isNotNull()).groupBy("user").agg(_peak().alias("p"))
    return best.select("user", X.round_half_up(F.col("p.bytes").cast("double") / 3600.0, 2).alias("peak_bytes_per_second"),
                       (-F.col("p.neg_hour")).alias("peak_hour"), F.col("p.bytes").alias("total_peak_bytes"))


def protocol_diversity(flows: DataFrame) -> DataFrame:
    """Count and sorted list of protocols; protocol names form a small closed set."""
    names = F.array_sort(F.collect_set("protocol"))
    return grouped(flows, "user").agg(names.alias("protocols")).select(
        "user", F.size("protocols").alias("unique_protocols"), "protocols")


def watched_ports(flows: DataFrame) -> DataFrame:
    return grouped(flows.where(F.col("dst_port").isin(S.WATCHED_PORTS)), "user", "dst_port").agg(
        rows("hits")).withColumnRenamed("dst_port", "port")


def dns_stats(flows: DataFrame) -> DataFrame:
    return user_hours(flows).groupBy("user").agg(
        F.sum("dns_rows").alias("dns_queries"), F.sum("dns_bytes").alias("dns_bytes"))


def daily_bytes(flows: DataFrame) -> DataFrame:
    return grouped(flows.withColumn("date", F.to_date("timestamp")), "user", "date").agg(sum_bytes())


def download_upload(flows: DataFrame) -> DataFrame:
    base = user_hours(flows).groupBy("user").agg(
        F.sum("download_bytes").alias("download_bytes"), F.sum("upload_bytes").alias("upload_bytes"))
    ratio = F.when(F.col("upload_bytes") > 0, X.round_half_up(_double("download_bytes") / _double("upload_bytes"), 2))
    return base.withColumn("ratio", ratio)


def connection_count(flows: DataFrame) -> DataFrame:
    return grouped(flows, "user").agg(rows("connections"))


def hour_variance(by_hour: DataFrame) -> DataFrame:
    """Population variance of each user's 24 zero-filled hourly sums, from exact integer sums."""
    b = F.col("bytes").cast("decimal(19,0)")
    sums = by_hour.where(F.col("hour").isNotNull()).groupBy("user").agg(
        F.sum(b).cast("decimal(19,0)").alias("s"), F.sum((b * b).cast("decimal(37,0)")).cast("decimal(37,0)").alias("q"))
    spread = (F.col("q") * 24 - (F.col("s") * F.col("s"))).cast("double")
    return sums.select("user", (spread / F.lit(576.0)).alias("variance"))


def variance_baseline(flows: DataFrame) -> DataFrame:
    """Median over users of the hourly variance; one row."""
    return Q.exact_quantiles(hour_variance(user_hours(flows)), "variance", {"median_variance": 0.5}, Q.double_key)


def population_stats(flows: DataFrame) -> DataFrame:
    """Mean and sample deviation of user totals; one row."""
    totals = grouped(flows, "user").agg(sum_bytes())
    value = F.col("bytes").cast("double")
    return totals.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
                      F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def user_features(flows: DataFrame) -> DataFrame:
    """One row per user with all numbers the tags and the text summary are drawn from."""
    by_hour = user_hours(flows)
    summed = ["n", "bytes", "vpn_bytes", "tls_rows", "dns_rows", "dns_bytes", "download_bytes", "upload_bytes",
              "suspicious_rows", "weekend_bytes", "weekday_bytes", "weekday_rows",
              *[f"cat_{c}" for c in _CLASSES], *[f"port_{p}_rows" for p in S.WATCHED_PORTS]]
    hour, size = F.col("hour"), F.col("bytes")
    b = size.cast("decimal(19,0)")

    def in_hours(name: str, *hours: int) -> Column:
        return F.coalesce(F.sum(F.when(hour.isin(*hours), size)), F.lit(0).cast("bigint")).alias(name)

    per_user = by_hour.groupBy("user").agg(
        *[F.sum(c).alias(c) for c in summed],
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.bool_and("all_internal").alias("all_internal"),
        F.count("hour").alias("active_hours"),
        F.count_if(size > 0).alias("positive_hours"),
        F.max("bytes").alias("max_hour_bytes"),
        F.max(F.when(hour.isNotNull(), F.struct(size.alias("bytes"), (-hour).alias("neg_hour")))).alias("peak"),
        in_hours("late_bytes", 22, 23, 0, 1, 2),
        in_hours("early_bytes", 6, 7, 8, 9),
        in_hours("night_bytes", 0, 1, 2, 3, 4, 5),
        # At most 24 hours and one null hour per user.
        F.map_from_entries(F.array_sort(F.collect_list(F.when(hour.isNotNull(), F.struct(
            hour.alias("k"), F.struct(size.alias("bytes"), F.col("n").alias("count")).alias("v")))))).alias("hours_map"),
        F.sum(b).cast("decimal(19,0)").alias("s"),
        F.sum((b * b).cast("decimal(37,0)")).cast("decimal(37,0)").alias("q"))
    spread = (F.col("q") * 24 - (F.col("s") * F.col("s"))).cast("double")
    return (per_user.withColumn("variance", spread / F.lit(576.0))
            .withColumn("peak_hour", -F.col("peak.neg_hour")).drop("s", "q", "peak"))


def breakdown_maps(flows: DataFrame) -> DataFrame:
    """Protocol percentages and daily bytes per user from one scan and one shuffle.

    Each flow feeds both break-downs; partial aggregation folds them before the shuffle. The
    maps stay small: protocols are a closed set, days are the calendar.
    """
    pairs = F.array(F.struct(F.lit("protocol").alias("kind"), F.col("protocol").alias("key")),
                    F.struct(F.lit("day").alias("kind"), F.to_date("timestamp").cast("string").alias("key")))
    sums = (flows.where(F.col("user").isNotNull()).select("user", "bytes", F.inline(pairs))
            .where(F.col("key").isNotNull()).groupBy("user", "kind", "key").agg(sum_bytes()))

    def entries(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "bytes"))))

    folded = sums.groupBy("user").agg(entries("protocol").alias("p"), entries("day").alias("d"),
                                      F.sum(F.when(F.col("kind") == "protocol", F.col("bytes"))).alias("total"))
    share = F.transform("p", lambda e: F.struct(e["key"].alias("key"), X.share_pct(e["bytes"], F.col("total")).alias("pct")))
    return folded.select("user", F.map_from_entries(share).alias("protocol_ratio"), F.map_from_entries("d").alias("daily_bytes"))


def profile_rows(flows: DataFrame) -> DataFrame:
    """Feature columns, tags and all profile maps per user: two scans of the flows, one join."""
    from flowloom.operators.tags import tagged_users

    def entry_map(pairs: list, kind: str, positive: str) -> Column:
        listed = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v"), F.col(c).alias("n")) for k, v, c in pairs])
        kept = F.filter(listed, lambda e: e["n"] > 0)
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"], e["v"]))).cast(kind).alias(positive)

    shares = [(c, X.share_pct(F.col(f"cat_{c}"), F.col("bytes")), f"cat_{c}") for c in sorted(_CLASSES)]
    ports = [(p, F.col(f"port_{p}_rows"), f"port_{p}_rows") for p in sorted(S.WATCHED_PORTS)]
    base = tagged_users(flows).withColumns({
        "category_pct": entry_map(shares, "map<string,double>", "category_pct"),
        "port_stats": entry_map(ports, "map<int,bigint>", "port_stats"),
        "dns_stats": F.struct(F.col("dns_rows").alias("dns_queries"), F.col("dns_bytes")),
    }).withColumnRenamed("hours_map", "active_hours_map")
    empty = {"protocol_ratio": "map<string,double>", "daily_bytes": "map<string,bigint>"}
    return base.join(breakdown_maps(flows), "user", "left").withColumns(
        {name: F.coalesce(F.col(name), F.create_map().cast(kind)) for name, kind in empty.items()})


_SECTIONS = ["tags", "category_pct", "active_hours_map", "protocol_ratio", "port_stats", "dns_stats", "daily_bytes"]


def profiles(flows: DataFrame) -> DataFrame:
    """Nested profile rows: tags, shares, hours, protocols, watched ports, DNS and daily bytes."""
    return profile_rows(flows).select(
        "user", F.col("bytes").alias("total_bytes"), F.col("n").alias("total_packets"), *_SECTIONS).withColumnRenamed(
        "active_hours_map", "active_hours")


def full_reports(flows: DataFrame) -> DataFrame:
    """Profile sections plus range, ratios, peak and reach of every user."""
    reach = grouped(flows, "user").agg(F.countDistinct("dst_ip").alias("unique_destinations"))
    hours = F.coalesce(span_seconds(F.col("first_ts"), F.col("last_ts")), F.lit(0.0)) / F.lit(3600.0)
    names = F.array_sort(F.map_keys("protocol_ratio"))
    return profile_rows(flows).join(reach, "user", "left").withColumn("h", hours).select(
        "user", F.col("bytes").alias("total_bytes"), F.col("n").alias("packet_count"),
        F.coalesce("unique_destinations", F.lit(0)).alias("unique_destinations"),
        F.col("first_ts").alias("range_start"), F.col("last_ts").alias("range_end"),
        F.col("tls_rows").alias("encrypted_packets"), (F.col("n") - F.col("tls_rows")).alias("unencrypted_packets"),
        X.share_pct(F.col("tls_rows"), F.col("n")).alias("encryption_ratio"),
        F.when(F.col("h") > 0, X.round_half_up(_double("n") / F.col("h"), 2)).otherwise(0.0).alias("connections_per_hour"),
        F.when(F.col("h") > 0, X.round_half_up(F.col("h"), 2)).otherwise(0.0).alias("total_hours"),
        X.round_half_up(_double("max_hour_bytes") / F.lit(3600.0), 2).alias("peak_bytes_per_second"), "peak_hour",
        F.col("max_hour_bytes").alias("total_peak_bytes"), F.size(names).alias("unique_protocols"), names.alias("protocols"),
        "download_bytes", "upload_bytes",
        F.when(F.col("upload_bytes") > 0, X.round_half_up(_double("download_bytes") / _double("upload_bytes"), 2)).alias("ratio"),
        *_SECTIONS).withColumnRenamed("active_hours_map", "active_hours")


def text_summary(flows: DataFrame) -> DataFrame:
    """One sentence per user: totals, leading class (name breaks ties) and tags."""
    from flowloom.operators.tags import tagged_users

    leading = F.array_max(F.array(*[F.struct(F.col(f"cat_{c}").alias("b"), F.lit(-i).alias("r"), F.lit(c).alias("c"))
                                    for i, c in enumerate(sorted(_CLASSES))]))
    top_class = F.when(leading["b"] > 0, leading["c"]).otherwise("unknown")
    tags = F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise("none")
    return tagged_users(flows).select("user", F.format_string(
        "%s: %d bytes in %d rows, mostly %s, tags: %s", "user", "bytes", "n", top_class, tags).alias("summary"))

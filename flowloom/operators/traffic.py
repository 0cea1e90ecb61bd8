"""Traffic aggregates over a flow table. Every function is ``DataFrame -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom import schema as S
from flowloom.functions import quantiles as Q
from flowloom.functions import scalars as X
from flowloom.session import durable
from flowloom.operators.common import grouped, rows, span_seconds, sum_bytes, top

_STEPS = {"hour": 3600, "5min": 300}


def with_time_parts(flows: DataFrame) -> DataFrame:
    """Add ``hour`` and ``date``."""
    return flows.withColumns({"hour": F.hour("timestamp"), "date": F.to_date("timestamp")})


def totals(flows: DataFrame, approx: bool = False) -> DataFrame:
    """Bytes, rows, users, and the sum of distinct sources and distinct destinations."""
    distinct = F.approx_count_distinct if approx else F.countDistinct
    return flows.agg(
        sum_bytes(name="total_bytes"), rows("total_packets"),
        distinct("user").alias("unique_users"),
        (distinct("src_ip") + distinct("dst_ip")).alias("src_plus_dst_ips"))


def top_by_bytes(flows: DataFrame, key: str, top_n: int) -> DataFrame:
    return top(grouped(flows, key).agg(sum_bytes()), "bytes", key, top_n)


def top_users(flows: DataFrame, top_n: int = 10) -> DataFrame:
    return top_by_bytes(flows, "user", top_n)


def top_users_by_rows(flows: DataFrame, top_n: int = 10) -> DataFrame:
    return top(grouped(flows, "user").agg(F.count("timestamp").alias("packets")), "packets", "user", top_n)


def protocol_counts(flows: DataFrame) -> DataFrame:
    return grouped(flows, "protocol").agg(rows("packets"))


def bandwidth(flows: DataFrame) -> DataFrame:
    base = flows.agg(sum_bytes(), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    span = F.coalesce(span_seconds(F.col("a"), F.col("b")), F.lit(0.0))
    rate = X.round_half_up(F.col("bytes").cast("double") / F.col("span"), 2)
    return base.withColumn("span", span).select(
        F.when(F.col("span") > 0, rate).otherwise(0.0).alias("bytes_per_second"),
        F.when(F.col("span") > 0, X.round_half_up(F.col("span"), 2)).otherwise(0.0).alias("total_seconds"))


def session_span(flows: DataFrame) -> DataFrame:
    """Spread of each user's first-to-last span."""
    per_user = grouped(flows, "user").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    # Whole microseconds add up exactly in any order.
    micros = per_user.select((span_seconds(F.col("a"), F.col("b")) * 1e6).cast("bigint").alias("us"))
    return micros.agg(
        X.round_half_up(F.sum("us").cast("double") / F.count("us").cast("double") / F.lit(1e6), 2).alias("avg_seconds"),
        X.round_half_up(F.min("us").cast("double") / F.lit(1e6), 2).alias("min_seconds"),
        X.round_half_up(F.max("us").cast("double") / F.lit(1e6), 2).alias("max_seconds"),
        rows("total_sessions"))


def category_bytes(flows: DataFrame) -> DataFrame:
    return grouped(flows, "app_category").agg(sum_bytes())


def _bucket(step_seconds: int) -> Column:
    """Bucket number of the row's timestamp, independent of any session time zone."""
    return F.floor(X.epoch_micros(F.col("timestamp")) / F.lit(step_seconds * 1_000_000))


#: Buckets of an empty run that one row expands to.
GAP_PIECE = 65_536


def fill_gaps(buckets: DataFrame, measures: list[str], step_seconds: int) -> DataFrame:
    """Numbered buckets (column ``bucket``) to a gap-free time line with zero rows.

    Each present bucket stands for itself and the empty run up to the next one. The window sees one row per
    present bucket, i.e. calendar-bounded. A run is dealt over tasks in pieces of ``GAP_PIECE`` buckets before it is
    expanded, so a gap of centuries fills no task.
    """
    following = F.lead("bucket").over(Window.orderBy("bucket"))
    length = F.coalesce(F.col("_next") - F.col("bucket"), F.lit(1))
    pieces = buckets.withColumn("_next", following).withColumn("_len", length).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_len") - 1) / F.lit(GAP_PIECE)))))
    first = F.col("bucket") + F.col("_piece") * F.lit(GAP_PIECE)
    spread = pieces.repartition("bucket", "_piece").withColumn(
        "_b", F.explode(F.sequence(first, F.least(F.col("bucket") + F.col("_len"), first + F.lit(GAP_PIECE)) - 1)))
    return spread.select(
        X.from_epoch_seconds(F.col("_b") * step_seconds).alias("time"),
        *[F.when(F.col("_b") == F.col("bucket"), F.col(m)).otherwise(F.lit(0).cast("bigint")).alias(m)
          for m in measures])


def trend(flows: DataFrame, unit: str = "hour") -> DataFrame:
    """Bytes per hour or per five minutes, empty buckets included."""
    if unit not in _STEPS:
        raise ValueError(f"unit must be one of {sorted(_STEPS)}")
    buckets = (flows.where(F.col("timestamp").isNotNull())
               .groupBy(_bucket(_STEPS[unit]).alias("bucket")).agg(sum_bytes()))
    return fill_gaps(buckets, ["bytes"], _STEPS[unit])


def active_hours(flows: DataFrame) -> DataFrame:
    per_hour = flows.groupBy(F.hour("timestamp").alias("h")).agg(
        F.countDistinct("user").alias("active_users"), sum_bytes(name="total_bytes"),
        F.count("timestamp").alias("packet_count"))
    return per_hour.where(F.col("h").isNotNull()).select(
        X.hour_label(F.col("h")).alias("hour"), "active_users", "total_bytes", "packet_count")


def user_categories(flows: DataFrame, user: str | None = None) -> DataFrame:
    """Bytes per category for one user, or for all users at once."""
    if user is not None:
        flows = flows.where(F.col("user") == user)
    return grouped(flows, "user", "app_category").agg(sum_bytes())


def protocol_bytes(flows: DataFrame) -> DataFrame:
    return grouped(flows, "protocol").agg(sum_bytes())


def top_text(flows: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    """Most frequent non-blank values of a text column."""
    value = F.trim(F.col(column))
    counts = flows.where(F.coalesce(value, F.lit("")) != "").groupBy(value.alias("value")).agg(rows("packets"))
    return top(counts, "packets", "value", top_n)


def recent_downloads(flows: DataFrame, top_n: int = 20) -> DataFrame:
    """Latest downloads, newest first."""
    hit = flows.where(F.trim(F.coalesce(F.col("download_name"), F.lit(""))) != "")
    return hit.orderBy(F.col("timestamp").desc(), F.col("flow_id").desc()).limit(top_n).select(
        F.col("timestamp").alias("time"), F.col("download_name").alias("name"),
        F.when(F.col("hostname") != "", F.col("hostname")).otherwise(F.col("src_ip")).alias("source"),
        "content_type", "bytes")


def activity_summary(flows: DataFrame, top_n: int = 20) -> DataFrame:
    """Top hosts, processes and activities plus the latest downloads, in long form."""
    parts = [top_text(flows, column, top_n).select(
        F.lit(section).alias("section"), F.col("value").alias("name"), F.col("packets").alias("amount"))
        for section, column in (("host", "hostname"), ("process", "process_name"), ("activity", "activity"))]
    downloads = recent_downloads(flows, top_n).select(
        F.lit("download").alias("section"), F.concat_ws("|", "name", "source").alias("name"),
        F.col("bytes").alias("amount"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(downloads)


def top_talkers(flows: DataFrame, top_n: int = 10) -> DataFrame:
    return top_by_bytes(flows, "src_ip", top_n)


def date_range(flows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the inclusive date range.

    On a table partitioned by ``date`` the partition column is filtered, so other days are never
    read; else the range is put on the timestamp itself, which Parquet statistics can use.
    """
    if "date" in flows.columns:
        return flows.where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    first = F.to_date(F.lit(start)).cast("timestamp_ntz")
    after = F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp_ntz")
    return flows.where((F.col("timestamp") >= first) & (F.col("timestamp") < after))


def hourly_averages(flows: DataFrame) -> DataFrame:
    per_hour = flows.groupBy(F.hour("timestamp").alias("h")).agg(
        F.sum("bytes").alias("b"), F.count("bytes").alias("n"))
    return per_hour.where(F.col("h").isNotNull()).select(
        X.hour_label(F.col("h")).alias("hour"),
        X.round_half_up(F.col("b").cast("double") / F.col("n").cast("double"), 4).alias("avg_bytes"))


def daily_totals(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("timestamp").isNotNull()).groupBy(F.to_date("timestamp").alias("date")).agg(
        sum_bytes(name="total_bytes"), rows("total_packets"))


def growth(flows: DataFrame) -> DataFrame:
    """Change of the last present day over the present day before it, in percent."""
    last_two = daily_totals(flows).orderBy(F.col("date").desc()).limit(2)
    latest, previous = F.max_by("total_bytes", "date"), F.min_by("total_bytes", "date")
    change = (latest - previous).cast("double") / previous.cast("double") * 100.0
    return last_two.agg(F.when((F.count(F.lit(1)) == 2) & (previous != 0), X.round_half_up(change, 2))
                        .otherwise(0.0).alias("growth_pct"))


def exact_sample(flows: DataFrame, fraction: float = 0.1, seed: int = 0, key: str = "flow_id") -> DataFrame:
    """Repeatable sample of exactly max(1, int(rows * fraction)) rows.

    Rows are ranked by a hash of their key. The hash value that cuts the wanted number off is
    found as an exact order statistic, so the sample itself is one filter over the table: no
    global sort and no limit through one task.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15),
                  16, 10).cast("bigint")
    marked = flows.withColumn("_draw", draw)
    size = marked.agg(F.count(F.lit(1)).alias("n"))
    wanted = F.greatest(F.floor(F.col("n") * F.lit(fraction)), F.lit(1))
    cut = Q.order_statistic(marked, "_draw", size.select((wanted - 1).alias("rank")))
    return marked.where(F.col("_draw") <= cut.scalar()).drop("_draw")


def approximate_sample(flows: DataFrame, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """One-pass Bernoulli sample; the size is only close to rows * fraction."""
    return flows.sample(False, fraction, seed)


def user_count(flows: DataFrame, approx: bool = False) -> DataFrame:
    return flows.agg((F.approx_count_distinct if approx else F.countDistinct)("user").alias("unique_users"))


def top_ports(flows: DataFrame, top_n: int = 10) -> DataFrame:
    return top_by_bytes(flows, "dst_port", top_n).withColumnRenamed("dst_port", "port")


def tls_share(flows: DataFrame) -> DataFrame:
    both = flows.agg(sum_bytes(F.col("dst_port") == 443, "tls"), sum_bytes(name="total"))
    return both.select(F.coalesce(X.share_pct(F.col("tls"), F.col("total")), F.lit(0.0)).alias("tls_pct"))


def packet_size_stats(flows: DataFrame, approx: bool = False) -> DataFrame:
    """Smallest, largest, mean and median row size. The exact form reads the flows once, into a table of sizes and counts."""
    if approx:
        base = flows.agg(F.min("bytes").cast("double").alias("min"), F.max("bytes").cast("double").alias("max"),
                         X.round_half_up(F.sum("bytes").cast("double") / F.count("bytes").cast("double"), 2).alias("avg"))
        return base.withColumn("median", Q.approx_quantiles(flows, "bytes", {"median": 0.5}).scalar())
    counts = durable(Q.value_counts(flows, "bytes"))
    mean = F.sum(F.col("v") * F.col("n")).cast("double") / F.sum("n").cast("double")
    base = counts.agg(F.min("v").cast("double").alias("min"), F.max("v").cast("double").alias("max"), X.round_half_up(mean, 2).alias("avg"))
    return base.withColumn("median", Q.counted_quantiles(counts, {"median": 0.5}).scalar())


def hourly_users(flows: DataFrame) -> DataFrame:
    per_hour = flows.groupBy(F.hour("timestamp").alias("h")).agg(F.countDistinct("user").alias("active_users"))
    return per_hour.where(F.col("h").isNotNull()).select(X.hour_label(F.col("h")).alias("hour"), "active_users")


def concurrent_users(flows: DataFrame) -> DataFrame:
    """Distinct users per calendar hour."""
    per_hour = (with_time_parts(flows.where(F.col("timestamp").isNotNull())).groupBy("date", "hour")
                .agg(F.countDistinct("user").alias("active_users")))
    return per_hour.withColumn("hour", X.hour_label(F.col("hour")))


def _hour_bytes(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("timestamp").isNotNull()).groupBy(F.hour("timestamp").alias("hour")).agg(sum_bytes())


def peak_hour(flows: DataFrame) -> DataFrame:
    """Hour of day with most bytes; the lowest hour wins a tie."""
    return top(_hour_bytes(flows), "bytes", "hour", 1)


def idle_hours(flows: DataFrame, threshold_bytes: int = 100) -> DataFrame:
    """Hours 0..23 without rows or at most ``threshold_bytes``.

    Present hours arrive as at most 24 rows and become one map, which a fixed 24-entry
    sequence is checked against.
    """
    seen = _hour_bytes(flows).agg(F.map_from_entries(F.collect_list(F.struct("hour", "bytes"))).alias("m"))
    hours = seen.select("m", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return hours.where(F.coalesce(F.try_element_at("m", F.col("hour")), F.lit(0)) <= threshold_bytes).select("hour")


def heatmap(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("timestamp").isNotNull()).groupBy(
        F.weekday("timestamp").alias("day_of_week"), F.hour("timestamp").alias("hour")).agg(sum_bytes())


def anomaly_timeline(flows: DataFrame) -> DataFrame:
    """Hourly totals with a 0..1 distance from the mean in units of three deviations.

    The mean and deviation run over the hourly spine, zero hours included. A single bucket
    scores 0; a zero deviation counts as 1.
    """
    hourly = (flows.where(F.col("timestamp").isNotNull())
              .groupBy(_bucket(3600).alias("bucket"))
              .agg(sum_bytes(name="total_bytes"), rows("packet_count")))
    spine = fill_gaps(hourly, ["total_bytes", "packet_count"], 3600)
    # One row per hour of the calendar: the unpartitioned window stays small.
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value = F.col("total_bytes").cast("double")
    mean, deviation = F.avg(value).over(whole), F.stddev_samp(value).over(whole)
    safe = F.when(F.coalesce(deviation, F.lit(0.0)) == 0.0, 1.0).otherwise(deviation)
    score = F.least(F.lit(1.0), F.abs(value - mean) / (safe * 3.0))
    return spine.select("time", "total_bytes", "packet_count", X.round_half_up(score, 4).alias("anomaly_score"))


def compare_users(flows: DataFrame, user_a: str, user_b: str) -> DataFrame:
    """Two users side by side in long form: totals, active hours, protocols, categories, difference."""
    pair = flows.where(F.col("user").isin(user_a, user_b))

    def side(user: str, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("user") == user, F.col("v"))), F.lit(0).cast("bigint")).alias(name)

    scalar = grouped(pair, "user").agg(
        sum_bytes(name="total_bytes"), rows("total_packets"),
        F.countDistinct(F.hour("timestamp")).alias("active_hours"))
    metrics = scalar.select("user", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit("").alias("key"), F.col(m).alias("v"))
        for m in ("total_bytes", "total_packets", "active_hours")])))
    per = [grouped(pair, "user", c).agg(sum_bytes(name="v")).select(
        "user", F.lit(label).alias("metric"), F.col(c).alias("key"), "v")
        for label, c in (("protocol_bytes", "protocol"), ("category_bytes", "app_category"))]
    both = metrics.unionByName(per[0]).unionByName(per[1]).groupBy("metric", "key").agg(
        side(user_a, "user_a"), side(user_b, "user_b"))
    return both.withColumn("diff", F.col("user_a") - F.col("user_b"))


def weekday_split(flows: DataFrame) -> DataFrame:
    """Bytes per named day with the Mon-Fri and Sat-Sun sums on every row."""
    per_day = flows.where(F.col("timestamp").isNotNull()).groupBy(
        F.weekday("timestamp").alias("d")).agg(sum_bytes(name="day_bytes"))
    # At most seven rows reach the window.
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = F.array(*[F.lit(x) for x in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
                                         "Saturday", "Sunday")])
    part = {name: F.coalesce(F.sum(F.when(test, F.col("day_bytes"))).over(whole), F.lit(0).cast("bigint"))
            for name, test in (("weekday_bytes", F.col("d") < 5), ("weekend_bytes", F.col("d") >= 5))}
    return per_day.withColumns(part).select(
        F.element_at(names, F.col("d") + 1).alias("day"), "day_bytes", "weekday_bytes", "weekend_bytes")


def bytes_per_row(flows: DataFrame) -> DataFrame:
    return flows.agg(sum_bytes(), rows("n")).select(
        F.when(F.col("n") > 0, X.round_half_up(F.col("bytes").cast("double") / F.col("n").cast("double"), 2))
        .otherwise(0.0).alias("bytes_per_packet"))


def devices_per_user(flows: DataFrame) -> DataFrame:
    return grouped(flows, "user").agg(F.countDistinct("src_ip").alias("devices"))


def top_categories(flows: DataFrame, top_n: int = 5) -> DataFrame:
    return top_by_bytes(flows, "app_category", top_n)


def family_bytes(flows: DataFrame) -> DataFrame:
    """Bytes per port family; ports are summed first, then mapped by a fixed table."""
    per_port = grouped(flows, "dst_port").agg(sum_bytes(), rows("packets"))
    family = F.coalesce(X.port_family(F.col("dst_port")), F.lit("other"))
    return per_port.groupBy(family.alias("family")).agg(
        F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))


def port_families() -> dict[str, list[int]]:
    return {name: list(ports) for name, ports in S.PORT_FAMILIES.items()}

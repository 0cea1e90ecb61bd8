"""Ad-hoc reports: detailed statistics, search, timeline, topology and single-user views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.functions import quantiles as Q
from flowloom.functions import scalars as X
from flowloom.operators import profile as P
from flowloom.operators import traffic as B
from flowloom.operators.common import grouped, rows, sum_bytes
from flowloom.session import durable

QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def detailed_stats(flows: DataFrame, approx: bool = False) -> DataFrame:
    """Totals, bytes per user and quantiles of row sizes.

    The exact form reads the flows once: sizes and users are counted by one grouping, and sums, counts and all ranks come from
    the stored counts.
    """
    if approx:
        base = flows.agg(sum_bytes(name="total_bytes"), rows("total_packets"), F.countDistinct("user").alias("unique_users"))
        q = Q.approx_quantiles(flows, "bytes", QUANTILES)
    else:
        nothing = F.lit(None)
        both = F.array(F.struct(F.lit(0).alias("kind"), F.col("bytes").cast("bigint").alias("v"), nothing.cast("string").alias("u")),
                       F.struct(F.lit(1).alias("kind"), nothing.cast("bigint").alias("v"), F.col("user").alias("u")))
        stored = durable(flows.select(F.inline(both)).groupBy("kind", "v", "u").agg(F.count(F.lit(1)).alias("n")))
        base = stored.agg(F.coalesce(F.sum(F.col("v") * F.col("n")), F.lit(0).cast("bigint")).alias("total_bytes"),
                          F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.lit(0).cast("bigint")).alias("total_packets"),
                          F.count("u").alias("unique_users"))
        q = Q.counted_quantiles(stored.where("kind = 0 and v is not null").select("v", "n"), QUANTILES)
    mean = F.when(F.col("unique_users") > 0,
                  X.round_half_up(F.col("total_bytes").cast("double") / F.col("unique_users").cast("double"), 2)).otherwise(0.0)
    packed = q.select(F.struct(*[X.round_half_up(F.col(c), 4).alias(c) for c in QUANTILES]).alias("q")).scalar()
    full = base.withColumns({"per_user_avg_bytes": mean, "q": packed})
    return full.select("total_bytes", "total_packets", "unique_users", "per_user_avg_bytes",
                       F.col("q.p50").alias("median_traffic_bytes"), "q.*")


def data_info(flows: DataFrame) -> DataFrame:
    return flows.agg(
        rows("row_count"), F.min("timestamp").alias("range_start"), F.max("timestamp").alias("range_end"),
        F.countDistinct("user").alias("unique_users"), sum_bytes(name="total_bytes")).withColumn(
        "columns", F.lit(",".join(flows.columns)))


def random_rows(flows: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """A repeatable handful of ``n`` rows."""
    if n < 1:
        raise ValueError("n must be positive")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("flow_id").cast("string")))
    return flows.orderBy(draw).limit(n)


def search_filter(query: str, regex: bool = False) -> Column:
    """Match user, addresses or category; literal by default, a pattern on request."""
    q = query.strip().lower()
    if not q:
        raise ValueError("query must not be blank")

    def hit(column: Column) -> Column:
        return F.coalesce(column.rlike(q) if regex else column.contains(q), F.lit(False))

    return (hit(F.lower("user")) | hit(F.col("src_ip")) | hit(F.col("dst_ip")) | hit(F.lower("app_category")))


def search_totals(flows: DataFrame, query: str, regex: bool = False) -> DataFrame:
    return flows.where(search_filter(query, regex)).agg(
        rows("total_matches"), sum_bytes(name="total_bytes"), F.countDistinct("user").alias("unique_users"))


def search_rows(flows: DataFrame, query: str, regex: bool = False, n: int = 50) -> DataFrame:
    """First ``n`` matches by flow id: the sample shown next to the totals."""
    return flows.where(search_filter(query, regex)).orderBy("flow_id").limit(n)


def timeline(flows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Hourly bytes between two inclusive moments, empty hours as 0."""
    if start:
        flows = flows.where(F.col("timestamp") >= F.to_timestamp_ntz(F.lit(start)))
    if end:
        flows = flows.where(F.col("timestamp") <= F.to_timestamp_ntz(F.lit(end)))
    return B.trend(flows, "hour")


def topology_edges(flows: DataFrame) -> DataFrame:
    return grouped(flows, "src_ip", "dst_ip").agg(rows("connections"), sum_bytes()).withColumnsRenamed(
        {"src_ip": "source", "dst_ip": "target"})


def topology_nodes(flows: DataFrame) -> DataFrame:
    """Every address once per role with its number of distinct peers."""
    edges = topology_edges(flows)
    ends = F.array(F.struct(F.lit("source").alias("role"), F.col("source").alias("ip")),
                   F.struct(F.lit("destination").alias("role"), F.col("target").alias("ip")))
    return edges.select("connections", F.inline(ends)).groupBy("role", "ip").agg(
        rows("degree"), F.sum("connections").alias("connections"))


def protocol_table(flows: DataFrame) -> DataFrame:
    g = grouped(flows, "protocol").agg(sum_bytes(), F.count("timestamp").alias("packet_count"))
    # One row per protocol reaches the window.
    total = F.sum("bytes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return g.withColumn("percentage", F.coalesce(X.share_pct(F.col("bytes"), total), F.lit(0.0)))


def user_card(flows: DataFrame, user: str | None = None) -> DataFrame:
    """Totals, distinct targets and time range per user."""
    if user is not None:
        flows = flows.where(F.col("user") == user)
    return grouped(flows, "user").agg(
        sum_bytes(name="total_bytes"), rows("packet_count"), F.countDistinct("dst_ip").alias("unique_destinations"),
        F.min("timestamp").alias("range_start"), F.max("timestamp").alias("range_end"))


def user_card_sections(flows: DataFrame, user: str | None = None) -> DataFrame:
    """(user, section, name, bytes, packets): hours and raw categories of one user, or of every user."""
    if user is not None:
        flows = flows.where(F.col("user") == user)
    hour = F.hour("timestamp")
    parts = F.array(F.struct(F.lit("hour").alias("section"), F.when(hour.isNotNull(), X.hour_label(hour)).alias("name")),
                    F.struct(F.lit("category").alias("section"), F.col("app_category").alias("name")))
    # Both groupings share one pass and one shuffle.
    return grouped(flows.select("user", "bytes", "timestamp", F.inline(parts)), "user", "section", "name").agg(
        sum_bytes(), F.count("timestamp").alias("packets"))


def user_full_report(flows: DataFrame, user: str | None = None) -> DataFrame:
    """Card, ratios, peak, nested profile and raw category split of one user, or of every user at once.

    Tags compare with the whole population, so all users are profiled in either case.
    """
    entry = F.struct(F.col("app_category"), F.col("bytes"))
    split = B.user_categories(flows, user).groupBy("user").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("app_distribution"))
    full = P.full_reports(flows)
    return (full if user is None else full.where(F.col("user") == user)).join(split, "user", "left")


def report_sections(flows: DataFrame, user: str | None = None) -> DataFrame:
    """(user, section, name, amount): the full report in long form, with the fleet's tables under a null user."""
    full = user_full_report(flows, user)
    measures = ("total_bytes", "packet_count", "unique_destinations", "encrypted_packets", "unencrypted_packets", "encryption_ratio",
                "connections_per_hour", "total_hours", "peak_bytes_per_second", "peak_hour", "total_peak_bytes", "unique_protocols",
                "download_bytes", "upload_bytes", "ratio")
    entry = lambda section, name, amount: F.struct(
        F.lit(section).alias("section"), name.cast("string").alias("name"), amount.cast("double").alias("amount"))
    single = full.select("user", F.inline(F.array(*(entry("measure", F.lit(m), F.col(m)) for m in measures)))).where("amount is not null")
    lists = full.select("user", F.inline(F.concat(
        F.transform("protocols", lambda p: entry("protocol", p, F.lit(1))), F.transform("tags", lambda t: entry("tag", t, F.lit(1))),
        F.transform(F.map_entries(F.coalesce("app_distribution", F.create_map().cast("map<string,bigint>"))),
                    lambda e: entry("category", e["key"], e["value"])))))
    hours = user_card_sections(flows, user).where("section = 'hour'").select("user", F.inline(F.array(
        entry("hour_bytes", F.col("name"), F.col("bytes")), entry("hour_packets", F.col("name"), F.col("packets")))))
    out = single.unionByName(lists).unionByName(hours)
    for section, frame in global_tables(flows).items():
        key, amount = frame.columns[0], "bytes" if "bytes" in frame.columns else frame.columns[1]
        out = out.unionByName(frame.select(F.lit(None).cast("string").alias("user"), F.inline(F.array(entry(section, F.col(key), F.col(amount))))))
    return out


def global_tables(flows: DataFrame) -> dict[str, DataFrame]:
    """The fleet-wide tables shown beside a user's report."""
    return {"traffic_ranking": B.top_users(flows, 10), "protocol_distribution": B.protocol_bytes(flows),
            "app_category": B.category_bytes(flows)}


def profile_search(flows: DataFrame, query: str = "", n: int | None = None) -> DataFrame:
    """User ids containing the query (all for a blank one); with ``n``, the first so many in name order."""
    found = P.users(flows).where(F.contains(F.lower("user"), F.lit(query.strip().lower())))
    return found if n is None else found.orderBy("user").limit(n)


def alert_search(alerts: DataFrame, query: str) -> DataFrame:
    """Alerts whose text contains the query, ignoring case."""
    text = F.lower(F.concat_ws(" ", "type", "severity", "title", "entity", "evidence"))
    return alerts.where(F.contains(text, F.lit(query.lower())))


def per_file_totals(flows: DataFrame) -> DataFrame:
    """Rows, bytes and users per input file, in one job over all files."""
    return flows.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        rows("records"), sum_bytes(name="total_bytes"), F.countDistinct("user").alias("unique_users"))

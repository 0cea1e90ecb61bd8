"""User features, scaling, score range, evidence and model summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.functions import quantiles as Q
from flowloom.functions import scalars as X
from flowloom.operators.common import endpoints
from flowloom.operators.profile import user_features
from flowloom.session import durable

CONTAMINATION, TOP_N, MIN_USERS, SEED = 0.1, 10, 5, 42
BUFFERED_USERS = 1_000_000


def feature_table(flows: DataFrame) -> DataFrame:
    """Ten features per user, from the hour roll-up and the endpoint roll-up."""
    base = user_features(flows).selectExpr(
        "user", "cast(bytes AS double) AS total_bytes", "cast(n AS double) AS total_packets",
        "cast(suspicious_rows AS double) AS suspicious_port_hits",
        "CASE WHEN bytes > 0 THEN cast(night_bytes AS double) / cast(bytes AS double) ELSE 0D END AS night_byte_ratio",
        "cast(dns_rows AS double) AS dns_query_count", "cast(max_hour_bytes AS double) AS max_hour_bytes",
        "cast(positive_hours AS double) AS active_hour_count",
        "CASE WHEN n > 0 THEN cast(bytes AS double) / cast(n AS double) ELSE 0D END AS avg_bytes_per_packet")
    reach = endpoints(flows).groupBy("user").agg(
        F.countDistinct("dst_ip").cast("double").alias("unique_dst_ips"),
        F.countDistinct("dst_port").cast("double").alias("unique_dst_ports"))
    filled = base.join(reach, "user", "left").na.fill(0.0, ["unique_dst_ips", "unique_dst_ports"])
    return filled.select("user", *S.FEATURE_NAMES)


def standardise(features: DataFrame) -> DataFrame:
    """(x - mean) / population deviation per column, constant columns to 0.

    Nine digits are kept, so that the summation order never shows in a model.
    """
    stats = features.agg(*[a for c in S.FEATURE_NAMES for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    packed = stats.select(F.struct("*").alias("st")).scalar()
    with_stats = features.withColumn("_st", packed)

    def scaled(name: str) -> Column:
        m, s = F.col(f"_st.m_{name}"), F.col(f"_st.s_{name}")
        # A deviation at rounding level marks a constant column.
        flat = F.coalesce(s, F.lit(0.0)) <= F.abs(m) * F.lit(1e-12)
        return F.when(flat, F.lit(0.0)).otherwise(X.round_half_up((F.col(name) - m) / s, 9)).alias(name)

    return with_stats.select("user", *[scaled(c) for c in S.FEATURE_NAMES])


def vectors(features: DataFrame) -> DataFrame:
    """(user, v array<double>) of the scaled features."""
    return standardise(features).select("user", F.array(*S.FEATURE_NAMES).alias("v"))


def contamination_for(users: int, contamination: float = CONTAMINATION) -> float:
    return min(contamination, max(1.0 / users, 0.01))


def scaled_scores(raw: DataFrame, column: str = "outlyingness") -> DataFrame:
    """Min-max to 0..100 with two digits, higher is more anomalous; a flat column scores 50."""
    span = raw.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("s")).scalar()
    ranged = raw.withColumn("_s", span)
    width = F.col("_s.hi") - F.col("_s.lo")
    score = F.when(width < 1e-9, 50.0).otherwise(X.round_half_up((F.col(column) - F.col("_s.lo")) / width * 100.0, 2))
    return ranged.withColumn("anomaly_score", score).drop("_s")


def flag_outliers(raw: DataFrame, users: int, contamination: float = CONTAMINATION) -> DataFrame:
    """Scores plus the flag: beyond the (1 - contamination) quantile of the outlyingness.

    The raw values are written once: range, quantile and result would each run the model again.
    """
    kept = durable(raw)
    share = 1.0 - contamination_for(users, contamination)
    # The built-in holds all values in one buffer; beyond this many users the ranks are narrowed down instead.
    if users <= BUFFERED_USERS:
        cut = kept.agg(F.percentile("outlyingness", share)).scalar()
    else:
        cut = Q.exact_quantiles(kept, "outlyingness", {"cut": share}, Q.signed_key).scalar()
    return scaled_scores(kept.withColumn("is_anomaly", F.col("outlyingness") > cut))


def within_user_evidence(features: DataFrame) -> DataFrame:
    """Three features with the largest deviation inside the user's own vector."""
    values = [F.round(F.col(c), 12) for c in S.FEATURE_NAMES]
    total = sum(values[1:], values[0])
    frame = features.withColumn("_mean", total / float(len(values)))
    squares = [(v - F.col("_mean")) * (v - F.col("_mean")) for v in values]
    frame = frame.withColumn("_std", F.sqrt(sum(squares[1:], squares[0]) / float(len(values))))
    width = F.when(F.col("_std") == 0.0, 1.0).otherwise(F.col("_std"))
    entries = F.array(*[F.struct((-F.abs((v - F.col("_mean")) / width)).alias("z"), F.lit(i).alias("i"),
                                 F.format_string(f"{c}=%.2f", X.round_half_up(F.col(c), 2)).alias("text"))
                        for i, (c, v) in enumerate(zip(S.FEATURE_NAMES, values))])
    top3 = F.transform(F.slice(F.array_sort(entries), 1, 3), lambda e: e["text"])
    return frame.select("user", top3.alias("evidence"))


def column_evidence(features: DataFrame) -> DataFrame:
    """Three features in which the user departs most from the population (the default)."""
    scaled = standardise(features).select("user", *[F.col(c).alias(f"z_{c}") for c in S.FEATURE_NAMES])
    both = features.join(scaled, "user")
    entries = F.array(*[F.struct((-F.abs(F.col(f"z_{c}"))).alias("z"), F.lit(i).alias("i"),
                                 F.format_string(f"{c}=%.2f", X.round_half_up(F.col(c), 2)).alias("text"))
                        for i, c in enumerate(S.FEATURE_NAMES)])
    top3 = F.transform(F.slice(F.array_sort(entries), 1, 3), lambda e: e["text"])
    return both.select("user", top3.alias("evidence"))


def top_anomalies(scored: DataFrame, features: DataFrame, top_n: int = TOP_N, within_user: bool = False) -> DataFrame:
    """Highest flagged users with severity, evidence and features; name breaks ties."""
    best = scored.where("is_anomaly").orderBy(F.col("anomaly_score").desc(), "user").limit(top_n)
    evidence = (within_user_evidence if within_user else column_evidence)(features)
    rounded = features.select("user", *[X.round_half_up(F.col(c), 2).alias(c) for c in S.FEATURE_NAMES])
    return (best.select("user", "anomaly_score", X.model_severity(F.col("anomaly_score")).alias("severity"))
            .join(evidence, "user").join(rounded, "user"))


def model_summary(scored: DataFrame) -> DataFrame:
    """Users, anomalies, normal users, highest and median score."""
    cents = scored.withColumn("_c", F.floor(F.col("anomaly_score") * 100.0 + 0.5))
    median = Q.exact_quantiles(cents, "_c", {"m": 0.5}).scalar()
    return cents.agg(F.count(F.lit(1)).alias("total_users"), F.count_if("is_anomaly").alias("anomaly_users"),
                     F.count_if(~F.col("is_anomaly")).alias("normal_users"),
                     F.max("anomaly_score").alias("max_score")).withColumn("median_score", X.round_half_up(median / 100.0, 2))

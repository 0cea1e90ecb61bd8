"""Behaviour tags: one boolean rule per tag over the per-user feature row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.functions import quantiles as Q
from flowloom.operators.common import grouped, sum_bytes
from flowloom.operators.profile import user_features
from flowloom.session import durable

_CLASSES = [*S.BROAD_CLASSES, "others"]


def _of_bytes(part: str) -> str:
    return f"(CASE WHEN bytes > 0 THEN cast({part} AS double) / cast(bytes AS double) * 100D ELSE 0D END)"


def _share(name: str) -> str:
    """Class share with two digits; classes without bytes count as zero."""
    part = f"cat_{name}"
    return (f"(CASE WHEN bytes > 0 AND {part} > 0 "
            f"THEN floor(cast({part} AS double) / cast(bytes AS double) * 100D * 100D + 0.5D) / 100D ELSE 0D END)")


_TOP_SHARE = "greatest(" + ", ".join(_share(c) for c in _CLASSES) + ")"
_PORT_ROWS = [f"port_{p}_rows" for p in S.WATCHED_PORTS]
_VARIES = "active_hours > 1 AND median_variance > 0"

# Tag to rule, over the columns of ``with_baselines(user_features(...))``.
TAG_RULES = {
    "heavy_collector": "n > 100",
    "internal_user": "all_internal",
    "external_user": "NOT all_internal",
    "vpn_user": _of_bytes("vpn_bytes") + " > 20",
    "bulk_downloader": "cast(bytes AS double) / cast(n AS double) > 1000D",
    "light_user": "bytes < 10000",
    "heavy_traffic": "pop_std > 0 AND cast(bytes AS double) > pop_mean + pop_std * 2D",
    "gamer": _share("game") + " > 30",
    "video_heavy": _share("video") + " > 40",
    "balanced": f"{_TOP_SHARE} > 0 AND {_TOP_SHARE} < 40",
    "social": f"{_share('social')} + {_share('chat')} > 30",
    "learner": _share("edu") + " > 20",
    "technical": " + ".join(_PORT_ROWS) + " > 20",
    "night_owl": _of_bytes("late_bytes") + " > 40",
    "early_riser": _of_bytes("early_bytes") + " > 30",
    "regular": f"{_VARIES} AND variance < median_variance * 0.5D",
    "volatile": f"{_VARIES} AND variance > median_variance * 1.5D",
    "possible_scan": " + ".join(f"int({c} > 0)" for c in _PORT_ROWS) + " >= 3",
    "suspicious_dns": "dns_rows > 50",
    "abnormal_hours": _of_bytes("late_bytes") + " > 60",
    "weekend_active": "cast(weekend_bytes AS double) > "
                      "cast(weekday_bytes AS double) / cast(greatest(weekday_rows, 1) AS double)",
    "morning_active": "peak_hour BETWEEN 6 AND 11",
    "afternoon_active": "peak_hour BETWEEN 12 AND 17",
}
TAGS = list(TAG_RULES)


def _marks(names: list[str]) -> Column:
    """Array of the tags whose rule holds, in rule order."""
    return F.expr("array_compact(array(" + ", ".join(
        f"CASE WHEN {TAG_RULES[n]} THEN '{n}' END" for n in names) + "))")


def with_baselines(features: DataFrame, median_variance: bool = True) -> DataFrame:
    """Add the population figures as uncorrelated scalar subqueries (one row each, no join)."""
    size = F.col("bytes").cast("double")
    stats = features.agg(F.struct(F.avg(size).alias("m"), F.stddev_samp(size).alias("s")).alias("st")).scalar()
    median = (Q.exact_quantiles(features.where(F.col("active_hours") > 0), "variance", {"m": 0.5}, Q.double_key).scalar()
              if median_variance else F.lit(0.0))
    return features.withColumns({
        "pop_mean": F.coalesce(stats["m"], F.lit(0.0)), "pop_std": F.coalesce(stats["s"], F.lit(0.0)),
        "median_variance": F.coalesce(median, F.lit(0.0))})


def tagged_users(flows: DataFrame) -> DataFrame:
    """Feature rows with ``tags array<string>`` in rule order.

    The feature rows feed the baselines as well as the tags, so they are written once: one scan
    of the flows instead of one per baseline.
    """
    return with_baselines(durable(user_features(flows))).withColumn("tags", _marks(TAGS))


def user_tags(flows: DataFrame, *names: str) -> DataFrame:
    """Long form (user, tag), all tags or the named ones. Unused baselines stay out of the plan."""
    wanted = [t for t in TAGS if t in names] if names else TAGS
    ready = user_features(flows)
    needs = {c for c in ("pop_mean", "median_variance") if any(c in TAG_RULES[t] for t in wanted)}
    if needs:
        ready = with_baselines(durable(ready), "median_variance" in needs)
    return ready.select("user", F.explode(_marks(wanted)).alias("tag"))


def tag_index(flows: DataFrame) -> DataFrame:
    """Distinct tags with the number of users carrying each."""
    return user_tags(flows).groupBy("tag").agg(F.count(F.lit(1)).alias("users"))


def users_with_tag(flows: DataFrame, tag: str) -> DataFrame:
    """Users carrying one tag with their bytes."""
    totals = grouped(flows, "user").agg(sum_bytes(name="total_bytes"))
    return user_tags(flows, tag).join(totals, "user", "left").select(
        "tag", "user", F.coalesce(F.col("total_bytes"), F.lit(0).cast("bigint")).alias("total_bytes"))

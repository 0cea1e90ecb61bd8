"""Exact quantiles without pulling a column through one task.

``percentile`` keeps every distinct value of a group in one buffer. Here the values are first
counted per distinct value (partial aggregation before the shuffle), then the wanted ranks are
narrowed by a radix descent over an order-preserving 63-bit key: 21 bits per step, so no step
ever sorts more than 2^21 rows for one rank, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BITS = 21


def double_key(value: Column) -> Column:
    """Order-preserving bigint for a non-negative double (binary exponent, then mantissa)."""
    exponent = F.floor(F.log2(value))
    power = F.pow(F.lit(2.0), exponent.cast("double"))
    mantissa = F.floor((value / power - F.lit(1.0)) * F.lit(float(2 ** 52))).cast("bigint")
    return F.when(value > 0.0, (exponent + F.lit(1100)) * F.lit(2 ** 52) + mantissa).otherwise(
        F.lit(0).cast("bigint"))


def signed_key(value: Column) -> Column:
    """Order-preserving bigint for any finite double."""
    return F.when(value < 0.0, -double_key(-value)).otherwise(double_key(value))


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], key=None) -> DataFrame:
    """One row with one linearly interpolated quantile per entry of ``probs``.

    ``value`` is a bigint column, or any orderable column with ``key`` mapping it to a bigint.
    An empty input gives nulls.
    """
    return counted_quantiles(value_counts(df, value), probs, key)


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(v, n): rows per distinct value, nulls left out."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def counted_quantiles(counts: DataFrame, probs: dict[str, float], key=None) -> DataFrame:
    """As :func:`exact_quantiles`, from a table of (v, n); stored counts serve all steps without the rows."""
    k = key(F.col("v")) if key else F.col("v").cast("bigint")
    hist = (counts.withColumn("k", k)
            .withColumn("hi", F.shiftright("k", 2 * _BITS))
            .withColumn("mid", F.shiftright("k", _BITS)))
    per_mid = hist.groupBy("hi", "mid").agg(F.sum("n").alias("n"))
    per_hi = per_mid.groupBy("hi").agg(F.sum("n").alias("n"))

    # Top level: at most 2^21 rows by construction, one row per leading 21 bits.
    top = (per_hi
           .withColumn("before", F.coalesce(F.sum("n").over(
               Window.orderBy("hi").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("total", F.sum("n").over(
               Window.orderBy("hi").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    wanted = F.array(*[F.struct(F.lit(name).alias("q"), F.lit(float(p)).alias("p"), F.lit(side).alias("side"))
                       for name, p in probs.items() for side in (0, 1)])
    position = F.col("w.p") * (F.col("total") - 1).cast("double")
    rank = F.when(F.col("w.side") == 0, F.floor(position)).otherwise(F.ceil(position))
    hit = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))
    level0 = (top.withColumn("w", F.explode(wanted)).withColumn("pos", position).withColumn("rank", rank)
              .where(hit)
              .select("w.q", "w.side", "pos", "hi", (F.col("rank") - F.col("before")).alias("rank")))

    def descend(frame: DataFrame, targets: DataFrame, bucket: str, order: str, keep: str) -> DataFrame:
        # Two target rows per quantile: the broadcast is bounded by the argument list.
        w = Window.partitionBy("q", "side").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return (frame.join(F.broadcast(targets), bucket)
                .withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
                .where(hit)
                .select("q", "side", "pos", keep, (F.col("rank") - F.col("before")).alias("rank")))

    level1 = descend(per_mid, level0, "hi", "mid", "mid")
    level2 = descend(hist.select("mid", "k", "v", "n"), level1, "mid", "k", "v")

    def interpolated(name: str) -> Column:
        def at(side: int) -> Column:
            return F.max(F.when((F.col("q") == name) & (F.col("side") == side), F.col("v").cast("double")))
        pos = F.max(F.when(F.col("q") == name, F.col("pos")))
        return (at(0) + (at(1) - at(0)) * (pos - F.floor(pos).cast("double"))).alias(name)

    return level2.agg(*[interpolated(name) for name in probs])


def approx_quantiles(df: DataFrame, value: str, probs: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """One scan with small mergeable summaries; rank error at most rows / accuracy."""
    return df.agg(*[F.percentile_approx(value, p, accuracy).cast("double").alias(name)
                    for name, p in probs.items()])


def order_statistic(df: DataFrame, value: str, rank: DataFrame) -> DataFrame:
    """Value at the zero-based rank given by the one-row frame ``rank``, as a one-row frame.

    Made for columns whose values are nearly all different, such as hashes: nothing is counted
    per value over the whole table. Each of three narrow scans counts at most 2^21 prefixes
    (combined before the shuffle) and keeps the prefix that holds the rank.
    """
    key = F.col(value)

    def counts(frame: DataFrame, shift: int) -> DataFrame:
        return frame.groupBy(F.shiftright(key, shift).alias("k")).agg(F.count(F.lit(1)).alias("n"))

    def step(frame: DataFrame, wanted: Column) -> DataFrame:
        before = F.coalesce(F.sum("n").over(
            Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return (frame.withColumn("before", before).withColumn("rank", wanted)
                .where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
                .select(F.struct("k", (F.col("rank") - F.col("before")).alias("rank")).alias("t")))

    hi = step(counts(df, 2 * _BITS), rank.scalar()).scalar()
    inside_hi = df.where(F.shiftright(key, 2 * _BITS) == hi["k"])
    mid = step(counts(inside_hi, _BITS), hi["rank"]).scalar()
    inside_mid = df.where(F.shiftright(key, _BITS) == mid["k"])
    return step(counts(inside_mid, 0), mid["rank"]).select("t.k")

"""Mixing sources to target sizes by entropy balancing (operator 2).

Document rates exp(a + b z) with a source's own a and b, z the log of the size, are the closest to rate 1
(in relative entropy, by words) that give every source its target of words and keep its mean of z.
Newton steps on the convex dual find a and b for all sources at once; each step is one aggregation over
the (source, size) counts. Rates become whole copies by carrying the rounding error from long to short documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowloom.llm.storage import Workspace

CAP = 3
_SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def _meet(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Join on the named columns, null meeting null; the other columns of both sides stay."""
    right = right.select(*[F.col(n).alias(f"__{n}") for n in names], *[F.col(c).alias(c) for c in right.columns if c not in names])
    met = F.lit(True)
    for n in names:
        met = met & left[n].eqNullSafe(F.col(f"__{n}"))
    return left.join(right, met, how).drop(*[f"__{n}" for n in names])


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; no target
    exceeds ``cap`` times its source's size, and what is above goes to the others by weight. With the
    sources sorted by size per weight, the capped ones are a prefix, so one pass over the source table
    (one row a source) finds the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(place) - 1) % len(weights) + 1)
    per = per.withColumn("w", weight)
    everything = W.partitionBy(F.lit(1))
    order = W.partitionBy(F.lit(1)).orderBy((F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - cap * before) / after
    per = per.withColumn("level", level)
    fits = F.when(cap * F.col("source_size") / F.col("w") >= F.col("level"), F.struct(F.col("source_size") / F.col("w"), "level"))
    per = per.withColumn("level", F.min(fits).over(everything)["level"])
    return per.select("source", "source_size", F.least(
        (cap * F.col("source_size")).cast("double"), F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))).alias("target"))


def balance(counts: DataFrame, goals: DataFrame, work: Workspace, tolerance: float = 1e-12, steps: int = 60) -> DataFrame:
    """(source, a, b): the dual solution for (source, size, n) and (source, target).

    Constraints of a source: words taken = target, and the mean of ln(size), weighted by words taken, as
    in the source itself. Sources without words or with target 0 have no row.
    """
    z = F.log(F.col("size").cast("double"))
    rows = counts.where("size > 0").select("source", z.alias("z"), (F.col("size").cast("double") * F.col("n")).alias("words"))
    mean = rows.groupBy("source").agg((F.sum(F.col("words") * F.col("z")) / F.sum("words")).alias("mean"))
    known = work.save("known", _meet(rows, mean, "source").select("source", (F.col("z") - F.col("mean")).alias("z"), "words"))
    goals = goals.where("target > 0").select("source", "target")
    now = work.save("dual0", goals.select("source", "target", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("gap")))
    for step in range(1, steps + 1):
        rate = F.col("words") * F.exp(F.col("a") + F.col("b") * F.col("z"))
        sums = _meet(known, now, "source").groupBy("source").agg(
            F.sum(rate).alias("s0"), F.sum(rate * F.col("z")).alias("s1"), F.sum(rate * F.col("z") * F.col("z")).alias("s2"))
        # Gradient (target - s0, -s1); Hessian ((s0, s1), (s1, s2)). A single size leaves b at 0.
        det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
        flat = det <= 1e-12 * F.col("s0") * F.col("s0")
        g = F.col("target") - F.col("s0")
        da = F.when(flat, g / F.col("s0")).otherwise((F.col("s2") * g + F.col("s1") * F.col("s1")) / det)
        db = F.when(flat, 0.0).otherwise((-F.col("s1") * g - F.col("s0") * F.col("s1")) / det)
        limit = F.greatest(F.lit(1.0), F.abs(da), F.abs(db))
        moved = _meet(now.drop("gap"), sums, "source").select(
            "source", "target", (F.col("a") + da / limit).alias("a"), (F.col("b") + db / limit).alias("b"),
            F.greatest(F.abs(g) / F.col("target"), F.abs(F.col("s1")) / F.col("target")).alias("gap"))
        now = work.save(f"dual{step}", moved)
        if now.where(F.col("gap") > tolerance).limit(1).count() == 0:
            break
    return now.select("source", "a", "b")


def _deal(cap: int):
    """Whole copies of each (size, n) of one source: what is due so far less what is taken, rounded."""

    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values("size", ascending=False)
        due = taken = 0
        copies = []
        for size, n, rate in zip(groups["size"].tolist(), groups["n"].tolist(), groups["rate"].tolist()):
            due += rate * size * n
            unit = size * 1_000_000_000
            give = min(max((2 * (due - taken) + unit) // (2 * unit), 0), cap * n) if size else 0
            taken += give * unit
            copies.append(give)
        return groups.assign(copies_all=copies)[["source", "size", "n", "copies_all"]]

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken; given columns of these names are replaced.

    Size is the number of words (runs without ASCII white space; null text: 0). Copies are whole, from 0
    to ``cap``. From long to short, the documents of a source and size get together as many copies as
    are due so far and not yet taken, so a source ends within about its shortest document of its
    target; among themselves they share the copies evenly. This runs over (source, size) counts, as many
    as a source has different sizes.
    Ties in size go by a residue of doc_id, then doc_id (null first); repeated rows are rows of their own.
    Null is a source of its own. An empty table gives an empty table.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    work = Workspace(docs.sparkSession, "mixing")
    salt = F.coalesce(F.pmod(F.col("doc_id"), F.lit(_SALTS)), F.lit(0)).cast("int")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    narrow = work.save("sizes", docs.select("source", size.alias("size"), salt.alias("salt")))
    groups = work.save("groups", narrow.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n")))
    goals = work.save("goals", targets(groups.select("source", (F.col("size") * F.col("n")).alias("size")), weights, cap))
    counts = groups.groupBy("source", "size").agg(F.sum("n").alias("n"))
    words = F.col("size").cast("double") * F.col("n")
    means = counts.where("size > 0").groupBy("source").agg(
        (F.sum(words * F.log(F.col("size").cast("double"))) / F.sum(words)).alias("mean"))
    solved = _meet(balance(counts, goals, work), means, "source")
    rate = F.least(F.lit(float(cap)), F.exp(F.col("a") + F.col("b") * (F.log(F.col("size").cast("double")) - F.col("mean"))))
    # Billionths, so that all sums below are whole numbers and repeat exactly.
    rated = _meet(counts, solved, "source", how="left").select(
        "source", "size", "n", F.when(F.col("size") > 0, F.coalesce(F.round(rate * 1e9), F.lit(0.0))).otherwise(0.0)
        .cast("long").alias("rate"))
    dealt = work.save("dealt", rated.groupBy("source").applyInPandas(
        _deal(cap), "source string, size long, n long, copies_all long"))
    earlier = W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = groups.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    plan = _meet(_meet(dealt, offsets, "source", "size"), goals, "source").withColumnRenamed("salt", "__salt")
    ranked = docs.withColumns({"size": size, "__salt": salt}).withColumn("__n", F.row_number().over(
        W.partitionBy("source", "size", "__salt").orderBy("doc_id")))
    joined = _meet(ranked, plan, "source", "size", "__salt")
    upto = lambda rank: F.expr(f"(({rank}) * copies_all) div n")
    copies = (upto("offset + __n") - upto("offset + __n - 1")).cast("int")
    return joined.select(*docs.columns, "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))

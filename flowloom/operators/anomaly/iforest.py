"""Isolation forest: bounded samples build the trees on executors, every user is scored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.operators.anomaly import features as U
from flowloom.session import durable

TREES, SAMPLE = 120, 256
_NODES = "tree int, node int, feature int, threshold double, left int, right int, path double"


def average_path(size: np.ndarray | int):
    """Mean path length of an unsuccessful search in a binary tree of ``size`` points."""
    n = np.asarray(size, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    points = np.array(pdf.sort_values(["draw", "user"])["v"].tolist())
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes, open_nodes = [], [(0, np.arange(len(points)), 0)]
    count = 1
    while open_nodes:
        node, rows, depth = open_nodes.pop()
        sub = points[rows]
        spread = sub.max(axis=0) - sub.min(axis=0)
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append((tree, node, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
            continue
        feature = int(rng.choice(usable))
        low = sub[:, feature].min()
        threshold = float(low + rng.random() * spread[feature])
        below = sub[:, feature] <= threshold
        if below.all():  # rounding put the cut on the maximum
            below = sub[:, feature] < sub[:, feature].max()
            threshold = float(sub[below, feature].max())
        left, right = count, count + 1
        count += 2
        nodes.append((tree, node, feature, threshold, left, right, 0.0))
        open_nodes += [(left, rows[below], depth + 1), (right, rows[~below], depth + 1)]
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODES.split(", ")])


def drawn_users(vectors: DataFrame, users: int, trees: int = TREES, sample: int = SAMPLE, seed: int = U.SEED) -> DataFrame:
    """(tree, draw, v): for every tree the ``sample`` users of all whose draw is least, all of them if there are fewer.

    A draw is a hash of seed, tree and user, so it never depends on partitioning. Users beyond a threshold that lets
    through some twice as many as wanted are left out before the shuffle; the threshold is raised until no tree lacks users.
    What is left is cut to ``sample`` rows a tree in each task and once more after the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("draw", "user"))
    ahead = 2.0
    while True:
        share = min(1.0, ahead * sample / max(users, 1))
        limit = F.lit(int((share - 0.5) * 2.0 ** 64)) if share < 1.0 else F.lit((1 << 63) - 1)
        draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, "user").alias("draw")))
        near = vectors.select("user", "v", F.explode(F.filter(draws, lambda d: d["draw"] <= limit)).alias("d")).select("user", "v", "d.tree", "d.draw")
        drawn = near.withColumn("r", rank).where(F.col("r") <= sample).select("tree", "draw", "user", "v")
        if share >= 1.0:
            return drawn
        drawn = durable(drawn)
        counts = drawn.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(sample, users)).count()
        if counts == trees:
            return drawn
        ahead *= 8


def fit(vectors: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = U.SEED, users: int | None = None) -> pd.DataFrame:
    """All trees as one small node table (at most trees x 511 rows), each grown from a sample of all users."""
    drawn = drawn_users(vectors, vectors.count() if users is None else users, trees, sample, seed)
    return drawn.groupBy("tree").applyInPandas(lambda pdf: _grow(pdf, seed), _NODES).toPandas()


def outlyingness(vectors: DataFrame, nodes: pd.DataFrame, users: int, sample: int = SAMPLE) -> DataFrame:
    """2^(-mean path / expected path) per user, in one Arrow pass with the broadcast forest."""
    forest = []
    for _, tree in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append({c: tree[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")})
    shared = vectors.sparkSession.sparkContext.broadcast(forest)
    expected = float(average_path(min(sample, users)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = np.array(batch["v"].tolist())
            total, at_row = np.zeros(len(x)), np.arange(len(x))
            for tree in shared.value:
                node = np.zeros(len(x), dtype=int)
                while True:
                    feature = tree["feature"][node]
                    inner = feature >= 0
                    if not inner.any():
                        break
                    go_left = x[at_row, np.maximum(feature, 0)] <= tree["threshold"][node]
                    node = np.where(inner, np.where(go_left, tree["left"][node], tree["right"][node]), node)
                total += tree["path"][node]
            value = np.power(2.0, -total / len(shared.value) / max(expected, 1e-12))
            yield pd.DataFrame({"user": batch["user"], "outlyingness": np.round(value, 9)})

    return vectors.mapInPandas(score, "user string, outlyingness double")


def detect(vectors: DataFrame, users: int, contamination: float = U.CONTAMINATION, seed: int = U.SEED) -> DataFrame:
    nodes = fit(vectors, seed=seed, users=users)
    return U.flag_outliers(outlyingness(vectors, nodes, users), users, contamination)

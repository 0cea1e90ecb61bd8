"""Local outlier factor on exact nearest neighbours, without comparing all pairs.

Equal vectors are merged first and carry a weight, so copies never pile up in one task. The rest lies in a
two-level tree of boxes. The upper level is cut at medians of a sample whose size grows with the square root of the
data, so its cells hold about equally many points; a task cuts its cell further into leaves of at most
``LEAF`` points with their bounding boxes. A search takes leaves by distance, nearest first, and its radius shrinks
as it goes. Points whose radius leaves their upper cell visit the nearest other cell, and then every cell still in reach.
"""

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

#: Least points of an upper cell, points of a leaf, sampled points for each upper cell, queries of one task.
NEIGHBOURS, CELL, LEAF, SAMPLED, BLOCK = 20, 4_096, 128, 64, 20_000
#: Points compared with a group of queries at once.
STEP = 1_024
_SLACK = 1e-9  # keeps rounding from hiding a tie
_FOUND = "vid string, nid string, dist double, w bigint"


def distinct_points(vectors: DataFrame) -> DataFrame:
    """(vid, v, w): one row per different vector with the number of users sharing it.

    ``vid`` is a digest of the coordinates in steps of 1e-9, as :func:`U.vectors` rounds them, and of their text where
    they are finer.
    """
    steps = F.transform("v", lambda x: F.round(x * 1e9).cast("bigint"))
    plain = F.forall("v", lambda x: F.round(x * 1e9).cast("bigint") / 1e9 == x)
    text = F.array_join(F.transform("v", lambda x: x.cast("string")), ",")
    vid = F.concat(F.md5(F.array_join(steps.cast("array<string>"), ",")), F.when(plain, "").otherwise(F.concat(F.lit(":"), F.md5(text))))
    return vectors.groupBy("v").agg(F.count(F.lit(1)).alias("w")).select(vid.alias("vid"), "v", "w")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise distances, one coordinate at a time: exact differences in little memory."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def box_distance(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of each point (or box, given as its own low and high) to each box; 0 inside."""
    first, last = (x, x) if not isinstance(x, tuple) else x
    total = np.zeros((len(first), len(low)))
    for j in range(low.shape[1]):
        gap = np.maximum(low[None, :, j] - last[:, j, None], first[:, j, None] - high[None, :, j])
        total += np.maximum(gap, 0.0) ** 2
    return np.sqrt(total)


def median_cuts(x: np.ndarray, leaves: int, most: int = 0) -> tuple[list[tuple[int, float, int, int]], list[np.ndarray]]:
    """Cuts (dimension, value, below, above) and the rows of each leaf; a negative side -1 - i is leaf i.

    The largest part is cut at the median of its widest dimension until there are ``leaves`` parts, or until none has more than
    ``most`` rows. Rows must differ from each other to be told apart.
    """
    cuts: list[tuple[int, float, int, int]] = []
    parts: list[np.ndarray] = []
    todo = [(np.arange(len(x)), leaves, None)]
    while todo:
        rows, share, place = todo.pop()
        spread = x[rows].max(axis=0) - x[rows].min(axis=0) if len(rows) else np.zeros(1)
        if (len(rows) <= most if most else share < 2) or len(rows) < 2 or not spread.max() > 0:
            number = -1 - len(parts)
            parts.append(rows)
        else:
            axis = int(spread.argmax())
            values = np.sort(x[rows, axis])
            value = values[(len(rows) - 1) // 2]
            if value == values[-1]:  # more than half lie on the maximum
                value = values[values < value][-1]
            below = x[rows, axis] <= value
            number = len(cuts)
            cuts.append((axis, float(value), 0, 0))
            todo += [(rows[~below], share // 2, (number, 3)), (rows[below], share - share // 2, (number, 2))]
        if place is not None:
            cut = list(cuts[place[0]])
            cut[place[1]] = number
            cuts[place[0]] = tuple(cut)
    return cuts, parts


def _leaf_of(x: np.ndarray, cuts: list[tuple[int, float, int, int]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64) if cuts else np.full(len(x), -1)
    table = np.array([(a, b, c) for a, _, b, c in cuts], np.int64).reshape(-1, 3)
    values = np.array([c[1] for c in cuts])
    while (inner := at >= 0).any():
        rows = np.flatnonzero(inner)
        axis, below, above = table[at[rows]].T
        at[rows] = np.where(x[rows, axis] <= values[at[rows]], below, above)
    return -1 - at


class Leaves:
    """Points of one upper cell in boxes."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        _, parts = median_cuts(points, 0, LEAF)
        self.order = np.concatenate(parts)
        self.bounds = np.cumsum([0, *map(len, parts)])
        self.points, self.ids, self.weights = points[self.order], ids[self.order], weights[self.order]
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in zip(self.bounds, self.bounds[1:])])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in zip(self.bounds, self.bounds[1:])])
        #: Places in the order of the ids, which settles equal distances.
        self.rank = np.empty(len(ids), np.int64)
        self.rank[np.argsort(self.ids, kind="stable")] = np.arange(len(ids))
        self.visits = self.asked = 0

    def nearest(self, queries: np.ndarray, names: np.ndarray, radius: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, distance) of the ``k`` nearest within each query's radius, itself left out."""
        home = box_distance(queries, self.low, self.high).argmin(axis=1) if len(queries) <= 4096 else np.concatenate(
            [box_distance(queries[i:i + 4096], self.low, self.high).argmin(axis=1) for i in range(0, len(queries), 4096)])
        found = [np.zeros((3, 0))]
        order = np.argsort(home, kind="stable")
        # Queries of one leaf go together, so that what is near to one is near to all.
        edges = np.flatnonzero(np.diff(home[order])) + 1
        for a, b in zip([0, *edges], [*edges, len(order)]):
            for at in range(a, b, LEAF):
                found.append(self._group(order[at:min(at + LEAF, b)], queries, names, radius, k))
        rows, places, dist = np.concatenate(found, axis=1)
        return rows.astype(np.int64), places.astype(np.int64), dist

    def _group(self, own: np.ndarray, queries: np.ndarray, names: np.ndarray, radius: np.ndarray, k: int) -> np.ndarray:
        x, limit = queries[own], radius[own].copy()
        far = box_distance((x.min(axis=0)[None], x.max(axis=0)[None]), self.low, self.high)[0]
        rows, places, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        todo, at = np.argsort(far, kind="stable"), 0
        self.asked += len(own)
        while at < len(todo) and far[todo[at]] <= limit.max() + _SLACK:
            stop, size = at, 0
            while stop < len(todo) and size < STEP and far[todo[stop]] <= limit.max() + _SLACK:
                size += self.bounds[todo[stop] + 1] - self.bounds[todo[stop]]
                stop += 1
            boxes, at = todo[at:stop], stop
            reach = box_distance(x, self.low[boxes], self.high[boxes]) <= limit[:, None] + _SLACK
            self.visits += int(reach.sum())
            sizes = self.bounds[boxes + 1] - self.bounds[boxes]
            wanted = np.repeat(self.bounds[boxes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            d = np.round(_distances(x, self.points[wanted]), 12)
            good = np.repeat(reach, sizes, axis=1) & (d <= limit[:, None] + _SLACK) & (names[own][:, None] != self.ids[wanted][None, :])
            r, c = np.nonzero(good)
            rows, places, dist = np.concatenate([rows, r]), np.concatenate([places, wanted[c]]), np.concatenate([dist, d[r, c]])
            best = np.lexsort((self.rank[places], dist, rows))
            rows, places, dist = rows[best], places[best], dist[best]
            first = np.searchsorted(rows, rows)
            keep = np.arange(len(rows)) - first < k
            rows, places, dist = rows[keep], places[keep], dist[keep]
            full = np.bincount(rows, minlength=len(own)) >= k
            last = np.searchsorted(rows, np.arange(len(own)), "right") - 1
            limit = np.where(full, np.minimum(limit, dist[np.maximum(last, 0)] if len(dist) else np.inf), limit)
        return np.stack([own[rows], places, dist])


def _search(queries: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """The k nearest points of the asked upper cell within the radius of each query (vid, v, cell, ub)."""
    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"vid": [], "nid": [], "dist": [], "w": []}).astype({"vid": str, "nid": str, "dist": float, "w": "int64"})
        leaves = Leaves(np.array(right["v"].tolist()), right["vid"].to_numpy(), right["w"].to_numpy())
        names = left["vid"].to_numpy()
        rows, places, dist = leaves.nearest(np.array(left["v"].tolist()), names, left["ub"].to_numpy(float), k)
        return pd.DataFrame({"vid": names[rows], "nid": leaves.ids[places], "dist": dist, "w": leaves.weights[places]})

    asked = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("nq"))
    left = queries.join(asked, "cell").select("vid", "v", "ub", F.col("cell").alias("cell"), F.pmod(F.xxhash64("vid"), F.col("nq")).cast("int").alias("qs"))
    right = placed.select("vid", "v", "w", "cell").join(asked, "cell").select(
        *(F.col(c).alias(c) for c in ("vid", "v", "w", "cell")), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qs"))
    return left.groupBy("cell", "qs").cogroup(right.groupBy("cell", "qs")).applyInPandas(block, _FOUND)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """Cut each point's candidates to exactly k neighbours, copies counted."""
    w = Window.partitionBy("vid").orderBy("dist", "nid").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("w").over(w), F.lit(0))
    return (found.withColumn("before", before).where(F.col("before") < k)
            .withColumn("w", F.least(F.col("w"), F.lit(k) - F.col("before"))).drop("before"))


def _place(points: DataFrame, count: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Points with their upper cell, and the cells' boxes (low, high)."""
    cells = math.ceil(count / max(CELL, 8 * math.isqrt(count)))
    sample = np.array([r["v"] for r in points.orderBy("vid").limit(SAMPLED * cells).select("v").collect()]) if cells > 1 else np.zeros((1, 1))
    cuts, _ = median_cuts(sample, cells)
    shared = points.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=_leaf_of(np.array(batch["v"].tolist()), shared.value).astype("int32"))

    placed = durable(points.mapInPandas(run, "vid string, v array<double>, w bigint, cell int"))
    size = len(points.select("v").first()["v"])
    rows = placed.groupBy("cell").agg(F.array(*(F.min(F.col("v")[i]) for i in range(size))).alias("low"),
                                      F.array(*(F.max(F.col("v")[i]) for i in range(size))).alias("high")).collect()
    low, high = np.full((len(cuts) + 1, size), np.inf), np.full((len(cuts) + 1, size), -np.inf)
    for r in rows:  # one row per upper cell
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
    return placed, low, high


def _other_cells(points: DataFrame, low: np.ndarray, high: np.ndarray, first: bool) -> DataFrame:
    """Other upper cells within each point's radius: the nearest one, or all but that one."""
    shared = points.sparkSession.sparkContext.broadcast((low, high))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lows, highs = shared.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512]
                far = box_distance(np.array(part["v"].tolist()), lows, highs)
                far[np.arange(len(part)), part["cell"].to_numpy()] = np.inf
                near = far.argmin(axis=1)
                reached = np.isfinite(far) & (far <= part["ub"].to_numpy()[:, None] + _SLACK)
                chosen = np.zeros_like(reached)
                chosen[np.arange(len(part)), near] = True
                rows, cells = np.nonzero(reached & (chosen if first else ~chosen))
                hit = part.iloc[rows]
                yield pd.DataFrame({"vid": hit["vid"].to_numpy(), "v": hit["v"].to_numpy(), "ub": hit["ub"].to_numpy(), "cell": cells.astype("int32")})

    return points.mapInPandas(run, "vid string, v array<double>, ub double, cell int")


def neighbours(points: DataFrame, k: int) -> DataFrame:
    """Exact k nearest neighbours (vid, nid, dist, w) of weighted distinct points."""
    placed, low, high = _place(points, points.count())
    start = placed.select("vid", "v", "cell", F.lit(float("inf")).alias("ub"))
    copies = placed.where("w > 1").select("vid", F.col("vid").alias("nid"), F.lit(0.0).alias("dist"), (F.col("w") - 1).alias("w"))
    near = durable(_nearest(_search(start, placed, k).unionByName(copies), k))
    if len(low) == 1:
        return near
    for first in (True, False):
        full = near.groupBy("vid").agg(F.sum("w").alias("got"), F.max("dist").alias("far"))
        limit = F.when(F.col("got") >= k, F.col("far")).otherwise(F.lit(float("inf")))
        bounded = placed.join(full, "vid", "left").select("vid", "v", "cell", F.coalesce(limit, F.lit(float("inf"))).alias("ub"))
        visits = durable(_other_cells(bounded, low, high, first))
        near = durable(_nearest(near.unionByName(_search(visits, placed, k)), k))
    return near


def outlyingness(vectors: DataFrame, users: int, k: int = NEIGHBOURS) -> DataFrame:
    """LOF per user: mean density of the neighbours over the own density."""
    k = min(k, users - 1)
    points = durable(distinct_points(vectors))
    near = durable(neighbours(points, k))
    reach_of = near.groupBy("vid").agg(F.max("dist").alias("kdist"))
    reached = near.join(reach_of.select(F.col("vid").alias("nid"), "kdist"), "nid").withColumn(
        "reach", F.greatest("kdist", "dist"))
    density = reached.groupBy("vid").agg(
        (F.lit(1.0) / (F.sum(F.col("reach") * F.col("w")) / F.sum("w") + 1e-10)).alias("lrd"))
    around = near.join(density.select(F.col("vid").alias("nid"), F.col("lrd").alias("nlrd")), "nid").groupBy("vid").agg(
        (F.sum(F.col("nlrd") * F.col("w")) / F.sum("w")).alias("nlrd"))
    factor = around.join(density, "vid").select("vid", F.round(F.col("nlrd") / F.col("lrd"), 9).alias("outlyingness"))
    named = points.join(factor, "vid").select("v", "outlyingness")
    return vectors.join(named, "v").select("user", "outlyingness")


def detect(vectors: DataFrame, users: int, contamination: float = U.CONTAMINATION) -> DataFrame:
    return U.flag_outliers(outlyingness(vectors, users), users, contamination)

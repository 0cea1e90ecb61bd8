"""One-class SVM with an RBF kernel, fitted by conditional gradient with away steps until the duality gap is small.

The kernel is replaced by seeded random cosine features. The dual of the one-class problem is a
minimum-norm point in the hull of the mapped points with capped weights, so each step needs only
two small sums over all users: a histogram of scores (to find the nu lowest) and the mean of the
mapped points below the cut, a vertex of that hull. Between two passes the driver moves weight among the vertices
met so far, away from bad ones as well. The model is one vector; nothing grows with the number of users.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.anomaly import features as U

FEATURES, BINS = 512, 1 << 16
#: The fit ends when the duality gap is at most this share of the squared norm, or after so many passes.
TOLERANCE, STEPS = 1e-3, 200


def _mapper(dimension: int, gamma: float, seed: int):
    rng = np.random.default_rng(seed)
    waves = rng.normal(scale=np.sqrt(2.0 * gamma), size=(dimension, FEATURES))
    phase = rng.uniform(0.0, 2.0 * np.pi, FEATURES)

    def mapped(rows: pd.Series) -> np.ndarray:
        return np.sqrt(2.0 / FEATURES) * np.cos(np.array(rows.tolist()) @ waves + phase)

    return mapped


def _sums(vectors: DataFrame, emit) -> dict[int, float]:
    """Add up (slot, value) pairs of all partitions; the number of slots is fixed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = emit(batch["v"])
                total = part if total is None else total + part
        if total is not None:
            slots = np.flatnonzero(total)
            yield pd.DataFrame({"slot": slots.astype("int32"), "value": total[slots]})

    rows = vectors.select("v").mapInPandas(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value"))
    return {r["slot"]: r["value"] for r in rows.collect()}


def _dense(sums: dict[int, float], size: int) -> np.ndarray:
    out = np.zeros(size)
    for slot, value in sums.items():
        out[slot] = value
    return out


class Fit(NamedTuple):
    """The model, how far its squared norm can be above the least one, and the passes it took."""

    weights: np.ndarray
    gap: float
    steps: int


def least_norm(vertices: np.ndarray, share: np.ndarray, tolerance: float, steps: int = 100_000) -> np.ndarray:
    """Shares of the vertices whose mix is shortest, by toward and away steps from ``share``."""
    gram = vertices @ vertices.T
    share = share.copy()
    for _ in range(steps):
        slope = gram @ share
        norm = float(share @ slope)
        toward = int(np.argmin(slope))
        held = np.flatnonzero(share > 0)
        away = int(held[np.argmax(slope[held])])
        if norm - slope[toward] <= tolerance and slope[away] - norm <= tolerance:
            break
        if norm - slope[toward] >= slope[away] - norm:
            way, most = -share, 1.0
            way = way.copy()
            way[toward] += 1.0
        else:
            way, most = share.copy(), share[away] / max(1.0 - share[away], 1e-300)
            way[away] -= 1.0
        bend, fall = float(way @ gram @ way), -float(way @ slope)
        if bend <= 0 or fall <= 0:
            break
        step = min(most, fall / bend)
        share = np.maximum(share + step * way, 0.0)
        if step == most and most < 1.0:
            share[away] = 0.0
        share /= share.sum()
    return share


def fit_model(vectors: DataFrame, users: int, nu: float, gamma: float, seed: int = U.SEED, steps: int = STEPS,
              tolerance: float = TOLERANCE) -> Fit:
    """Fit until the gap is within ``tolerance``; a fit that ends before says so in a warning.

    The gap counts the width of one score bin, since which points lie below the cut is known to a bin only.
    """
    mapped = _mapper(len(vectors.select("v").first()["v"]), gamma, seed)
    most = max(nu * users, 1.0)
    vertices = (_dense(_sums(vectors, lambda v: mapped(v).sum(axis=0)), FEATURES) / users)[None, :]
    share, gap, done = np.ones(1), np.inf, 0
    for done in range(1, steps + 1):
        w = share @ vertices
        # Scores lie between -|w| sqrt(2) and |w| sqrt(2); the bins cover just that.
        edge = max(float(np.linalg.norm(w)) * 1.4143, 1e-12)

        def bins(z: np.ndarray, w=w, edge=edge) -> np.ndarray:
            return np.clip(((z @ w + edge) / (2 * edge) * BINS).astype(int), 0, BINS - 1)

        def histogram(v: pd.Series, bins=bins) -> np.ndarray:
            return np.bincount(bins(mapped(v)), minlength=BINS).astype(float)

        below = np.cumsum(_dense(_sums(vectors, histogram), BINS))
        cut = int(np.searchsorted(below, most))
        under = below[cut - 1] if cut else 0.0
        part_of_bin = (most - under) / max(below[cut] - under, 1.0)

        def lowest(v: pd.Series, bins=bins, cut=cut, part_of_bin=part_of_bin) -> np.ndarray:
            z = mapped(v)
            b = bins(z)
            return np.where(b < cut, 1.0, np.where(b == cut, part_of_bin, 0.0)) @ z

        vertex = _dense(_sums(vectors, lowest), FEATURES) / most
        norm = float(w @ w)
        gap = max(0.0, norm - float(w @ vertex)) + 2 * edge / BINS * min(1.0, (below[cut] - under) / most)
        if gap <= tolerance * norm or norm < 1e-12:
            break
        vertices, share = np.vstack([vertices, vertex]), np.append(share, 0.0)
        share = least_norm(vertices, share, 0.1 * tolerance * norm)
        vertices, share = vertices[share > 0], share[share > 0]
    else:
        warnings.warn(f"one-class model stopped after {steps} passes with a duality gap of {gap:.2g}", stacklevel=2)
    return Fit(share @ vertices, gap, done)


def fit(vectors: DataFrame, users: int, nu: float, gamma: float, seed: int = U.SEED) -> np.ndarray:
    return fit_model(vectors, users, nu, gamma, seed).weights


def outlyingness(vectors: DataFrame, weights: np.ndarray, gamma: float, seed: int = U.SEED) -> DataFrame:
    mapped = _mapper(len(vectors.select("v").first()["v"]), gamma, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"user": batch["user"], "outlyingness": np.round(-(mapped(batch["v"]) @ weights), 9)})

    return vectors.mapInPandas(run, "user string, outlyingness double")


def detect(vectors: DataFrame, users: int, contamination: float = U.CONTAMINATION, seed: int = U.SEED) -> DataFrame:
    nu, gamma = U.contamination_for(users, contamination), 1.0 / len(vectors.select("v").first()["v"])
    weights = fit(vectors, users, nu, gamma, seed)
    return U.flag_outliers(outlyingness(vectors, weights, gamma, seed), users, contamination)

"""Nearest vectors by inner product through a block matrix join (operator 10).

Query blocks meet candidate blocks in cells. In a cell both sides are held as int8 with a step per row;
the int8 products give every inner product with a proven error bound, pairs whose upper bound reaches
the k-th best lower bound are worked out again in double precision, and tiles merge through heaps.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TILE = 1024
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole steps from -127 to 127 of each row, and the row's step. Rows too small to divide by get zeros and a step of 1."""
    step = np.abs(x).max(axis=1) / 127.0
    small = step < 1e-290
    step = np.where(small, 1.0, step)
    return np.where(small[:, None], 0, np.rint(x / step[:, None])).astype(np.int8), step


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added up in the order of the dimensions."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * c[:, j]
    return out


def _tile(q, q8, q_step, q_ids, c, c8, c_step, c_ids, k: int) -> list[list[tuple[float, int]]]:
    """The ``k`` best (-score, id) of one tile for each query, best first."""
    # float32 holds these whole-number products exactly up to 2**24; wider vectors use float64.
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    rough = (q8.astype(kind) @ c8.astype(kind).T).astype(np.float64) * q_step[:, None] * c_step[None, :]
    near = np.abs(q8.astype(np.float64)).sum(1) * q_step
    error = 0.5 * (q_step[:, None] * np.abs(c).sum(1)[None, :] + near[:, None] * c_step[None, :])
    error += 1e-12 * (np.abs(rough) + error)
    own = q_ids[:, None] == c_ids[None, :]
    wide = ~np.isfinite(rough) | ~np.isfinite(error)  # beyond double: such pairs are worked out, never bounded
    low = np.where(own | wide, -np.inf, rough - error)
    bar = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(q), -np.inf)
    row, col = np.nonzero((wide | (rough + error >= bar[:, None])) & ~own)
    score = np.concatenate([exact(q[row[i:i + 65536]], c[col[i:i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0)])
    ids = c_ids[col]
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    bounds = np.searchsorted(row, np.arange(len(q) + 1))
    return [list(zip((-score[a:min(b, a + k)]).tolist(), ids[a:min(b, a + k)].tolist())) for a, b in zip(bounds[:-1], bounds[1:])]


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for size in set(left["size"].to_pylist()) & set(right["size"].to_pylist()):
            sides = []
            for side in (left, right):
                own = side.filter(pa.compute.equal(side["size"], size)).combine_chunks()
                flat = pa.compute.list_flatten(own["v"]).to_numpy()
                sides.append((own["vec_id"].to_numpy(), np.asarray(flat, np.float64).reshape(-1, size)))
            (q_ids, q), (c_ids, c) = sides
            (q8, q_step), (c8, c_step) = quantise(q), quantise(c)
            for a in range(0, len(q), TILE):
                qs = slice(a, a + TILE)
                tiles = [_tile(q[qs], q8[qs], q_step[qs], q_ids[qs], c[b:b + TILE], c8[b:b + TILE], c_step[b:b + TILE],
                               c_ids[b:b + TILE], k) for b in range(0, len(c), TILE)]
                for i, query in enumerate(q_ids[qs].tolist()):
                    found += [(query, vec, -minus) for minus, vec in islice(heapq.merge(*(t[i] for t in tiles)), k)]
        columns = list(zip(*found)) if found else [[], [], []]
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, _OUT)], schema=_OUT)

    return run


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors of every query, all if fewer.

    ``vectors`` has vec_id and embedding. Queries are rows whose vec_id is divisible by ``every``;
    candidates are all others. Nearest is the largest inner product in double precision, ties go to the
    smaller vec_id. Rows with a null vec_id, and vectors that are null, empty, zero or hold a null or a
    non-finite number, take no part. Of rows with one vec_id the least vector counts. Vectors of
    different lengths are never compared. Copies of one vector are rows like others, so a common
    vector fills no single cell: rows are dealt to blocks by vec_id. Empty input gives an empty result.
    """
    fine = ("vec_id is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0) and not exists(embedding, "
            "x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    rows = vectors.where(fine).groupBy("vec_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("v"))
    rows = rows.withColumn("size", F.size("v"))
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    across, down = max(1, -(-total // block)), max(1, -(-asked // block))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("down", deal(down, 1)).withColumn(
        "across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    others = rows.withColumn("across", deal(across, 2)).withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    cells = queries.groupBy("across", "down").cogroup(others.groupBy("across", "down"))
    found = cells.applyInArrow(_cell(k), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

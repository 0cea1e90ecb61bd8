"""Exact top-k inner products through an M-tree searched best first (operator 11).

Vectors are dealt down a tree of routing vectors, level by level, until every region fits a task; each region becomes
pages: a routing vector, its covering radius, its distance to the parent's routing vector, and either pages below it or at
most ``PAGE`` vectors with their distances. A search takes the page with the greatest possible product first and
ends when no page left can reach the k-th best so far. By the triangle inequality a page's stored distance
bounds its products from the parent's alone, so most pages and vectors are passed over without a product.
"""

from __future__ import annotations

import heapq
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowloom.llm.storage import Workspace

#: Distinct vectors of a region, children of a page, vectors of a page, queries of one search task.
REGION, FANOUT, PAGE, QUERIES = 4096, 32, 64, 1024
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_PAGES = ("node string, page int, parent int, leaf boolean, center array<double>, radius double, norm double, away double, "
          "items array<long>, vectors array<double>, distances array<double>, ids array<array<long>>")


def distance(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row to one vector; a row has 0 to itself exactly."""
    with np.errstate(over="ignore"):
        return np.sqrt(((x - center) ** 2).sum(axis=1))


def products(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Inner products of whole numbers, exact, the ends of long standing for all beyond."""
    if not len(x) or not len(q):
        return [0] * len(x)
    with np.errstate(over="ignore"):
        fine = np.abs(q).max() * np.abs(x).max(axis=1) * len(q) < 2 ** 53
    if fine.all():
        return (x @ q).astype(np.int64).tolist()
    out = np.zeros(len(x), np.int64)
    out[fine] = (x[fine] @ q).astype(np.int64)
    own = [int(v) for v in q.tolist()]
    for i in np.flatnonzero(~fine).tolist():
        out[i] = min(_MOST, max(_LEAST, sum(a * int(b) for a, b in zip(own, x[i].tolist()))))
    return out.tolist()


class Query:
    """A query vector and upper bounds of its products."""

    def __init__(self, q: np.ndarray):
        self.q, self.square = q, float(q @ q)
        self.norm = sqrt(self.square)

    def to(self, center: np.ndarray, size: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """Product with each routing vector of that length, and distance to it."""
        product = center @ self.q
        return product, np.sqrt(np.maximum(self.square + size ** 2 - 2 * product, 0.0))

    def bound(self, product, distance_, reach, norm, size):
        """Most a vector of length up to ``norm`` within ``reach`` of a routing vector of length ``size`` can score.

        Its distance is at least ``distance_ - reach``, and its product with what lies between is at most their
        lengths' product. Rounding is allowed for; what can't be told is infinite.
        """
        near = np.maximum(distance_ - reach, 0.0)
        slack = 1e-9 * (self.square + (size + reach) ** 2 + norm ** 2 + 1.0)
        # Rounding in a squared distance can be large beside a small distance; the slack of its root covers it.
        near = np.maximum(near - np.sqrt(1e-12 * (self.square + size ** 2 + norm ** 2)), 0.0)
        out = np.minimum(product + self.norm * reach, (self.square + norm ** 2 - near ** 2) / 2) + slack
        return np.where(np.isnan(out), np.inf, np.maximum(out, float(_LEAST)))


class Best:
    """The k best (score, id) so far, higher scores first, then smaller ids; ``bar`` is what a score must reach."""

    def __init__(self, k: int, bar: float):
        self.k, self.bar, self.heap = k, bar, []

    def offer(self, score: int, vec_id: int) -> None:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -vec_id))
        else:
            heapq.heappushpop(self.heap, (score, -vec_id))
        if len(self.heap) == self.k:
            self.bar = max(self.bar, self.heap[0][0])


def grow(x: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> list[dict]:
    """Pages of one region, parents first. Rows of ``x`` are distinct."""
    norms = distance(x, np.zeros(x.shape[1]))
    pages: list[dict] = []
    root = int(np.argmin(distance(x, x.mean(axis=0)))) if len(x) else 0
    todo = [(-1, root, np.arange(len(x)), 0.0)]
    while todo:
        parent, center, rows, away = todo.pop()
        far = distance(x[rows], x[center])
        number = len(pages)
        pages.append({"parent": parent, "center": x[center], "radius": float(far.max()), "norm": float(norms[rows].max()), "away": away,
                      "rows": rows if len(rows) <= page else None, "distances": far if len(rows) <= page else None})
        if len(rows) <= page:
            continue
        # Each routing vector is the one farthest from those chosen before it.
        chosen, nearest, owner = [], np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        for i in range(min(fanout, max(2, -(-len(rows) // page)))):
            pick = int(np.argmax(far)) if i == 0 else int(np.argmax(nearest))
            if i and nearest[pick] == 0:
                break
            away_ = distance(x[rows], x[rows[pick]])
            owner, nearest = np.where(away_ < nearest, i, owner), np.minimum(away_, nearest)
            owner[pick] = i
            chosen.append(pick)
        todo += [(number, int(rows[pick]), rows[owner == i], float(far[pick])) for i, pick in enumerate(chosen)]
    return pages


class Region:
    """Pages of one region in a task."""

    def __init__(self, pages: pa.Table):
        order = np.argsort(pages["page"].to_numpy())
        size = len(pages["center"][0])
        column = lambda c: pages[c].to_numpy()[order]
        self.leaf, self.radius, self.norm, self.away = (column(c) for c in ("leaf", "radius", "norm", "away"))
        parent = column("parent")
        self.center = np.array(pages["center"].to_pylist(), np.float64).reshape(len(order), size)[order]
        self.size = distance(self.center, np.zeros(size))
        self.below = [np.flatnonzero(parent == i) for i in range(len(order))]
        pages = pages.take(pa.array(order))
        flat = lambda c: pages[c].combine_chunks().flatten()
        self.ids, self.distances = flat("ids").to_pylist(), flat("distances").to_numpy()
        self.vectors = flat("vectors").to_numpy().reshape(len(self.ids), size)
        held = np.cumsum([0] + [len(i) for i in pages["distances"]])
        self.rows = [np.arange(a, b) for a, b in zip(held[:-1], held[1:])]

    def search(self, query: Query, best: Best) -> None:
        product, away = query.to(self.center[:1], self.size[:1])
        bound = query.bound(product, away, self.radius[:1], self.norm[:1], self.size[:1])
        heap = [(-float(bound[0]), 0, float(product[0]), float(away[0]))]
        # Leaves are read best first, one, then two, four and so on together: few steps where the bar leaves many to read.
        leaves: list[tuple[int, float, float]] = []
        together = 1
        while heap:
            minus, page, product, away = heapq.heappop(heap)
            if -minus < best.bar:
                break
            if self.leaf[page]:
                leaves.append((page, product, away))
                if len(leaves) == together:
                    self.read(leaves, query, best)
                    leaves, together = [], 2 * together
                continue
            below = self.below[page]
            most = query.bound(product, away, self.away[below] + self.radius[below], self.norm[below], self.size[page])
            below = below[most >= best.bar]
            products_, aways = query.to(self.center[below], self.size[below])
            bounds = query.bound(products_, aways, self.radius[below], self.norm[below], self.size[below])
            for b, p, s, d in zip(bounds.tolist(), below.tolist(), products_.tolist(), aways.tolist()):
                if b >= best.bar:
                    heapq.heappush(heap, (-b, p, s, d))
        if leaves:
            self.read(leaves, query, best)

    def read(self, leaves: list[tuple[int, float, float]], query: Query, best: Best) -> None:
        """Offer the vectors of the leaves (page, product, distance) that can reach the bar."""
        pages, product, away = (np.array(x) for x in zip(*leaves))
        rows = np.concatenate([self.rows[p] for p in pages])
        owner = np.repeat(np.arange(len(pages)), [len(self.rows[p]) for p in pages])
        # The stored distance of each vector bounds its product before it is worked out.
        most = query.bound(product[owner], away[owner], self.distances[rows], self.norm[pages][owner], self.size[pages][owner])
        rows = rows[most >= best.bar]
        for score, i in zip(products(query.q, self.vectors[rows]), rows.tolist()):
            if score >= best.bar:
                for vec_id in self.ids[i]:
                    best.offer(score, vec_id)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _deal(rows: pa.Table, routes: pa.Table) -> pa.Table:
    """Each row to its nearest routing vector, the first of equals."""
    width = routes["size"][0].as_py()
    x, centers = _matrix(rows["v"], width), _matrix(routes["v"], width)
    nearest, owner = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for i, center in enumerate(centers):
        away = distance(x, center)
        owner, nearest = np.where(away < nearest, i, owner), np.minimum(away, nearest)
    names = routes["number"].to_numpy()
    children = [f"{node}/{n}" for node, n in zip(rows["node"].to_pylist(), names[owner].tolist())]
    out = {"node": pa.array(children, pa.string()), "item": rows["item"], "size": rows["size"], "v": rows["v"], "away": pa.array(nearest)}
    return pa.table(out)


def _plant(page: int, fanout: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("item")
        x, items, ids = _matrix(rows["v"], rows["size"][0].as_py()), rows["item"].to_numpy(), rows["ids"].to_pylist()
        pages = grow(x, page, fanout)
        held = lambda p, a: a[p["rows"]] if p["rows"] is not None else a[:0]
        n = len(pages)
        return pa.table({
            "node": pa.array([rows["node"][0].as_py()] * n, pa.string()), "page": pa.array(range(n), pa.int32()),
            "parent": pa.array([p["parent"] for p in pages], pa.int32()), "leaf": pa.array([p["rows"] is not None for p in pages]),
            "center": pa.array([p["center"] for p in pages], pa.list_(pa.float64())),
            **{c: pa.array([p[c] for p in pages], pa.float64()) for c in ("radius", "norm", "away")},
            "items": pa.array([held(p, items) for p in pages], pa.list_(pa.int64())),
            "vectors": pa.array([held(p, x).ravel() for p in pages], pa.list_(pa.float64())),
            "distances": pa.array([p["distances"] if p["rows"] is not None else [] for p in pages], pa.list_(pa.float64())),
            "ids": pa.array([[ids[i] for i in p["rows"]] if p["rows"] is not None else [] for p in pages], pa.list_(pa.list_(pa.int64())))})

    return run


def _visit(k: int):
    def run(queries: pa.Table, pages: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if len(queries) and len(pages):
            region = Region(pages)
            for item, v, bar in zip(*(queries[c].to_pylist() for c in ("item", "v", "bar"))):
                best = Best(k, bar)
                region.search(Query(np.array(v, np.float64)), best)
                found += [(item, -minus, score) for score, minus in best.heap]
        kinds = (("item", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()))
        return pa.table([pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

    return run


def _step(greedy: bool):
    """Queries of one node to its children: the one with the greatest bound, or all whose bound reaches the bar."""
    def run(queries: pa.Table, branches: pa.Table) -> pa.Table:
        names, out = queries.column_names, {"node": [], "row": []}
        if len(queries) and len(branches):
            width = queries["size"][0].as_py()
            center = _matrix(branches["center"], width)
            size = distance(center, np.zeros(width))
            radius, norm = (branches[c].to_numpy() for c in ("radius", "norm"))
            children = branches["child"].to_pylist()
            for i, (v, bar, seen) in enumerate(zip(*(queries[c].to_pylist() for c in ("v", "bar", "seen")))):
                query = Query(np.array(v, np.float64))
                bounds = query.bound(*query.to(center, size), radius, norm, size)
                for j in [int(np.argmax(bounds))] if greedy else np.flatnonzero(bounds >= bar).tolist():
                    if children[j] != seen:
                        out["node"].append(children[j])
                        out["row"].append(i)
        moved = queries.take(pa.array(out["row"], pa.int64()))
        return pa.table({c: pa.array(out["node"], pa.string()) if c == "node" else moved[c] for c in names})

    return run


class MTree:
    """Index tables: ``rows`` as given, ``items`` (distinct vectors with their least ids), ``branches`` of the upper levels,
    ``pages`` of the regions."""

    def __init__(self, work: Workspace, levels: int, rows: DataFrame, items: DataFrame, branches: DataFrame, pages: DataFrame):
        self.work, self.levels, self.rows, self.items, self.branches, self.pages = work, levels, rows, items, branches, pages


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, v): whole numbers floor(1024 x) of the vectors that take part, one row a vec_id."""
    fine = ("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) "
            "or abs(cast(x as double) * 1024) = double('infinity'))")
    # From 2**53 on a double is whole already, and its floor may not fit a long.
    whole = "transform(embedding, x -> case when abs(x * 1024d) < 9e15 then cast(floor(x * 1024d) as double) else x * 1024d end)"
    rows = vectors.where(fine).select("vec_id", F.expr(whole).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.select("vec_id", F.size("v").alias("size"), "v")


def build(rows: DataFrame, k: int, region: int = REGION, page: int = PAGE, fanout: int = FANOUT) -> MTree:
    """Index of (vec_id, size, v). Equal vectors are one item that keeps its ``k`` least ids: no search for ``k`` needs more."""
    spark = rows.sparkSession
    work = Workspace(spark, "mtree")
    rows = work.save("rows", rows)
    least = W.partitionBy("v").orderBy("vec_id")
    items = rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k).groupBy("size", "v").agg(
        F.min("vec_id").alias("item"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    items = work.save("items", items)
    open_, levels, settled, branches = items.select(F.col("size").cast("string").alias("node"), "item", "size", "v"), 0, [], []
    while True:
        counted = open_.join(open_.groupBy("node").agg(F.count(F.lit(1)).alias("total")), "node")
        settled.append(counted.where(F.col("total") <= region).drop("total"))
        large = counted.where(F.col("total") > region).withColumn("salts", F.ceil(F.col("total") / region).cast("int")).drop("total")
        if large.isEmpty():
            break
        first = W.partitionBy("node").orderBy(F.xxhash64("item", F.lit(levels)), "item")
        routes = work.save(f"routes{levels}", large.withColumn("number", F.row_number().over(first)).where(F.col("number") <= fanout).select(
            "node", "number", "size", "v", "salts"))
        spread = routes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        dealt = large.withColumn("salt", F.pmod(F.xxhash64("item", F.lit(-1)), F.col("salts")).cast("int"))
        open_ = work.save(f"level{levels}", dealt.groupBy("node", "salt").cogroup(spread.groupBy("node", "salt")).applyInArrow(
            _deal, "node string, item long, size int, v array<double>, away double"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        covers = open_.groupBy(F.col("node").alias("child")).agg(F.max("away").alias("radius"), F.max(norm).alias("norm"))
        named = routes.select("node", F.concat_ws("/", "node", F.col("number").cast("string")).alias("child"), F.col("v").alias("center"))
        branches.append(work.save(f"branches{levels}", named.join(covers, "child").select("node", "child", "center", "radius", "norm")))
        open_, levels = open_.drop("away"), levels + 1
    whole = settled[0]
    for part in settled[1:]:
        whole = whole.unionByName(part)
    whole = whole.join(items.select("item", "ids"), "item").select("node", "item", "size", "v", "ids")
    pages = work.save("pages", whole.groupBy("node").applyInArrow(_plant(page, fanout), _PAGES))
    upper = branches[0] if branches else spark.createDataFrame([], "node string, child string, center array<double>, radius double, norm double")
    for part in branches[1:]:
        upper = upper.unionByName(part)
    return MTree(work, levels, rows, items, upper, pages)


def _cells(frontier: DataFrame) -> DataFrame:
    """The (node, salt) that hold queries, as columns of their own."""
    return frontier.select(F.col("node").alias("node"), F.col("salt").alias("salt")).distinct()


def _descend(tree: MTree, frontier: DataFrame, greedy: bool, salts: int, name: str) -> DataFrame:
    """Queries from the roots down to the regions they visit."""
    salted = frontier.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)).cast("int"))
    kind = "node string, item long, size int, v array<double>, bar double, seen string, salt int"
    inner, arrived = tree.branches.select("node").distinct(), []
    for level in range(tree.levels):
        arrived.append(salted.join(inner, "node", "left_anti").select(*salted.columns))
        moving = salted.join(inner, "node", "left_semi").select(*salted.columns)
        wanted = tree.branches.join(_cells(moving), "node")
        salted = tree.work.save(f"{name}{level}", moving.groupBy("node", "salt").cogroup(wanted.groupBy("node", "salt")).applyInArrow(
            _step(greedy), kind))
    arrived.append(salted)
    out = arrived[0]
    for part in arrived[1:]:
        out = out.unionByName(part)
    return out


def _search(tree: MTree, frontier: DataFrame, k: int) -> DataFrame:
    # Only pages that some query visits are sent, once for each block of its queries.
    wanted = tree.pages.join(_cells(frontier), "node")
    return frontier.groupBy("node", "salt").cogroup(wanted.groupBy("node", "salt")).applyInArrow(_visit(k), "item long, vec_id long, score long")


def search(tree: MTree, queries: DataFrame, k: int) -> DataFrame:
    """(item, vec_id, score): the ``k`` best of every query row (item, size, v), its own vector included."""
    salts = max(1, -(-queries.count() // QUERIES))
    start = queries.select(F.col("size").cast("string").alias("node"), "item", "size", "v", F.lit(float("-inf")).alias("bar"),
                           F.lit("").alias("seen"))
    first = tree.work.save("first", _descend(tree, start, True, salts, "greedy"))
    found = tree.work.save("found", _search(tree, first, k))
    if not tree.levels:
        return found
    bars = found.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least"))
    # A score beyond 2**53 may be rounded up on its way to double.
    bar = F.when(F.col("n") >= k, F.col("least") - F.abs("least") * 1e-15).otherwise(F.lit(float("-inf")))
    again = start.drop("bar", "seen").join(bars, "item", "left").join(first.select("item", F.col("node").alias("seen")), "item").where(
        "node <> seen").select("node", "item", "size", "v", bar.alias("bar"), "seen")
    rest = tree.work.save("rest", _descend(tree, again, False, salts, "bounded"))
    return found.unionByName(_search(tree, rest, k))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, region: int = REGION, page: int = PAGE, fanout: int = FANOUT) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` greatest whole-number inner products of every query, all if fewer.

    ``vectors`` has vec_id and embedding; a component x counts as floor(1024 x) in double. Queries are rows whose vec_id is
    divisible by ``every``; candidates are all others; ties go to the smaller vec_id. Rows with a null vec_id, and
    vectors that are null, hold a null or non-finite number, or overflow double times 1024, take no part; zero and empty
    vectors do. Of rows with one vec_id the least vector counts. Vectors of different lengths are never compared. A score beyond
    long counts as the end of long. Empty input gives an empty result.

    Copies of a vector are one item, as a candidate and as a query, so a common vector fills no region and is searched
    once. Regions are split until they hold at most ``region`` distinct vectors. A query first visits the region with the greatest
    bound, then, with the score found there as its bar, every region that can reach it.
    """
    tree = build(usable(vectors), k + 1, region, page, fanout)
    asked = tree.rows.where(F.col("vec_id") % every == 0).join(tree.items.select("v", "item"), "v").select(
        F.col("vec_id").alias("query_id"), "item", "size", "v")
    asked = tree.work.save("asked", asked)
    one = asked.dropDuplicates(["item"]).select("item", "size", "v")
    best = W.partitionBy("item").orderBy(F.col("score").desc(), "vec_id")
    top = search(tree, one, k + 1).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = top.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("hits"))
    # A query's own row is left out of its item's list, and the rest counts from 1.
    others = F.filter("hits", lambda h: h["vec_id"] != F.col("query_id"))
    own = asked.select("query_id", "item").join(lists, "item").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "h"))
    return own.select("query_id", (F.col("at") + 1).alias("rank"), "h.vec_id", "h.score")

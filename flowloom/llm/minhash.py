"""Near-duplicate documents by BagMinHash signatures (operator 9).

The weight of a shingle is how often it occurs. Each (shingle, dyadic weight interval) runs a Poisson
process whose rate is the interval's length; a point has a time, a signature component and a weight
inside the interval, and counts only up to the document's weight. A component keeps the least time, so
two documents agree in it with a probability equal to their weighted Jaccard similarity. Points are
drawn until they come later than every component of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowloom.llm import hashing as H
from flowloom.llm.components import components
from flowloom.llm.storage import Workspace, text_key

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 6
#: Counters of a bag's sketch.
SKETCH = 128
#: Bytes of text or bags that are worked on at once, and points that are drawn at once when few processes go on.
_CHUNK, _POINTS = 1 << 18, 1 << 13
_letters: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _letters:
        known = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
        _letters[:] = [known, H.mix(np.arange(1, 0x110001, dtype=H.U))]
    return _letters[0], _letters[1]


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of each text (repeats stay), and the offsets of the texts.

    Words are runs of letters and digits in lower case. A text with fewer than ``size`` words, but
    at least one, has one shingle of all its words.
    """
    known, codes = _tables()
    data = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), "<u4") if texts else np.zeros(0, "<u4")
    lengths = [len(x.lower()) + 1 for x in texts]
    inside = np.concatenate(([False], known[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    words = H.mix(H.span(H.prefix(codes[data]), starts, ends) + (ends - starts).astype(H.U) * H.U(0xA0761D6478BD642F))
    offsets = np.searchsorted(starts, np.cumsum([0] + lengths))
    n = np.diff(offsets)
    counts = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    at, owner = H.ranges(offsets[:-1], counts)
    long = np.minimum(size, n)[owner]
    out = H.mix(H.span(H.prefix(words), at, at + long) + long.astype(H.U))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    for a, b in zip(bounds[:-1], bounds[1:]):
        out[a:b].sort()
    return out, bounds


def _bags(hashes: np.ndarray, bounds: np.ndarray):
    """Owner, hash and count of the distinct shingles."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if not len(hashes):
        return owner, hashes, owner
    first = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))))
    return owner[first], hashes[first], np.diff(np.concatenate((first, [len(hashes)])))


def signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures of ``n`` bags; a bag without elements keeps infinity everywhere."""
    levels = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64), 0) + 1
    level, source = H.ranges(np.zeros(len(counts), np.int64), levels)
    owner, limit = owner[source], counts[source].astype(float)
    key = H.mix(hashes[source] + level.astype(H.U) * H.U(0x8EBC6AF09C88C6E3))
    low = np.where(level > 0, np.exp2(level - 1.0), 0.0)
    rate = np.where(level > 0, low, 1.0)
    time = np.zeros(len(key))
    table = np.full(n * m, np.inf)
    turn = 0
    while len(key):
        # Points that come later than every component change nothing, so short bags can draw many turns at once.
        turns = np.arange(turn + 1, turn + 1 + max(1, min(_POINTS // len(key), m)), dtype=H.U)
        turn += len(turns)
        draw = H.mix(key[:, None] + turns * H.U(0x9E3779B97F4A7C15))
        gap = -np.log(((draw >> H.U(11)).astype(float) + 0.5) * 2.0**-53) / rate[:, None]
        gap[:, 0] += time
        times = np.cumsum(gap, axis=1, out=gap)
        other = H.mix(draw + H.U(0x589965CC75374CC3))
        weight = low[:, None] + rate[:, None] * ((other >> H.U(32)).astype(float) + 0.5) * 2.0**-32
        place = owner[:, None] * m + (other & H.U(0xFFFFFFFF)).astype(np.int64) % m
        taken = weight <= limit[:, None]
        np.minimum.at(table, place[taken], times[taken])
        time = times[:, -1].copy()
        going = time < table.reshape(n, m).max(1)[owner]
        if not going.all():
            key, time, owner, low, rate, limit = (x[going] for x in (key, time, owner, low, rate, limit))
    return table.reshape(n, m)


def _sign(bands: int, rows: int, size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int32()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in H.pieces(batch, _CHUNK):
                owner, hashes, counts = _bags(*shingles([x or "" for x in part["text"].to_pylist()], size))
                n = part.num_rows
                table = signatures(owner, hashes, counts, n, bands * rows).view(H.U).reshape(n, bands, rows)
                value = np.broadcast_to(np.arange(1, bands + 1, dtype=H.U), (n, bands)) * H.U(0xC2B2AE3D27D4EB4F)
                for i in range(rows):
                    value = H.mix(value + table[:, :, i] * H.U(0x9E3779B97F4A7C15))
                node = np.zeros(n, H.U)
                np.add.at(node, owner, H.mix(hashes * H.U(0xD6E8FEB86659FD93) + H.mix(counts.astype(H.U))))
                words = np.bincount(owner, minlength=n) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)),
                                                 pa.array(np.ascontiguousarray(value).view(np.int64).ravel()))
                yield pa.record_batch([part["doc_id"], part["tk"],
                                       pa.array(H.mix(node).view(np.int64), mask=~words), lists], schema=schema)

    return run


def _sets(size: int):
    """The multiset of each text as a sorted set: the i-th copy of a shingle is an element of its own.

    The sketch counts the elements by their highest bits, 255 standing for all beyond.
    """
    schema = pa.schema([("node", pa.int64()), ("bag", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in H.pieces(batch, _CHUNK):
                hashes, bounds = shingles(part["text"].to_pylist(), size)
                n = part.num_rows
                owner, _, counts = _bags(hashes, bounds)
                copy, _ = H.ranges(np.zeros(len(counts), np.int64), counts)
                keys = H.mix(hashes + copy.astype(H.U) * H.U(0xD6E8FEB86659FD93))
                of = np.repeat(np.arange(n), np.diff(bounds))
                cells = np.bincount(of * SKETCH + (keys >> H.U(57)).astype(np.int64), minlength=n * SKETCH)
                cells = np.minimum(cells, 255).astype(np.uint8).reshape(n, SKETCH)
                yield pa.record_batch([part["node"], pa.array(
                    [np.sort(keys[x:y]).tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary()),
                    pa.array(np.diff(bounds).astype(np.int64)), pa.array([c.tobytes() for c in cells], pa.binary())], schema=schema)

    return run


def _possible(threshold: float):
    """Pairs whose sketches leave it open that the bags overlap enough.

    Two bags that reach ``threshold`` differ in at most ``(1 - threshold) / (1 + threshold)`` of their elements, and
    their counters differ in no more than the bags do.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("sketch_a", "sketch_b"))
            n, m = (batch[c].to_numpy() for c in ("n_a", "n_b"))
            apart = np.maximum(np.abs(x - y).sum(axis=1, dtype=np.int64), np.abs(n - m))
            open_ = apart <= (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-6
            yield pa.record_batch([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(open_))

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in H.pieces(batch, _CHUNK, "bag"):
            bags = [np.frombuffer(x.as_buffer(), np.int64) for x in part["bag"]]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in bags]))).astype(np.int32)
            flat = pa.array(np.concatenate(bags) if bags else np.zeros(0, np.int64))
            yield pa.record_batch([part["node"], part["label"], pa.ListArray.from_arrays(pa.array(offsets), flat)],
                                  names=["node", "label", "elements"])


def candidates(bags: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different label in (node, label, bag) that may reach ``threshold``; no pair that does is left out.

    In one order of all elements, rarest first, two bags that overlap enough share an element among the
    first of each (prefix filter), early enough in both for the rest to make up the overlap (position filter).
    """
    rows = bags.mapInArrow(_elements, "node long, label long, elements array<long>").select(
        "node", "label", F.size("elements").alias("n"), F.explode("elements").alias("element"))
    often = rows.groupBy("element").agg(F.count(F.lit(1)).alias("often"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("often", "element"))), F.lit(1),
                    (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    heads = rows.join(often, "element").groupBy("node", "label", "n").agg(first.alias("head")).select(
        "node", "label", "n", F.posexplode("head").alias("at", "e")).where("e.often > 1").select(
        "node", "label", "n", F.col("e.element").alias("element"), (F.col("n") - F.col("at")).alias("rest"))
    least = (F.col("x.n") + F.col("y.n")) * (threshold / (1 + threshold)) - 1e-9
    met = ((F.col("x.element") == F.col("y.element")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
           & (F.least("x.rest", "y.rest") >= least))
    return heads.alias("x").join(heads.alias("y"), met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _overlap(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch["bag_a"], batch["bag_b"]):
                x, y = (np.frombuffer(v.as_buffer(), H.U) for v in (x, y))
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    found.append(0.0)
                    continue
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                found.append(common / (len(x) + len(y) - common))
            found = np.array(found)
            yield pa.record_batch([batch["a"], batch["b"], pa.array(found)], schema=schema).filter(pa.array(found >= threshold))

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS,
                    rows: int = ROWS, rounds: int = 2, centres: int = 4) -> DataFrame:
    """One row per input row: doc_id, tk (text key), class_id, class_size and first_of_class.

    Two texts are linked if the multisets of their word shingles overlap by ``threshold`` (sum of the
    lesser counts over sum of the greater); classes are the connected components. Texts with one
    multiset are one node. First, ``rounds`` times, one member of each class of a band bucket is compared with the
    bucket's centre (later with ``centres`` of them), which merges most of a large class at a cost of its classes, not pairs.
    Then all pairs that share a bucket and are still apart go through ``candidates`` and are verified, so
    every link between bucket mates counts. class_id is the least doc_id.
    Null texts and texts without words are classes of their own; null doc_ids take part but name no
    class unless all are null. Repeated rows share a class. first_of_class marks the least (doc_id, tk), all its repeats
    included. An empty table gives an empty table; other columns are not looked at.
    """
    work = Workspace(docs.sparkSession, "minhash")
    keyed = docs.select("doc_id", text_key().alias("tk"), "text")
    rows_ = work.save("rows", keyed.mapInArrow(_sign(bands, rows, size), "doc_id long, tk int, node long, bands array<long>"))
    nodes = rows_.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tk")).alias("src"), F.first("bands").alias("bands"))
    spread = work.save("spread", nodes.select("node", F.col("src.doc_id").alias("doc_id"), F.col("src.tk").alias("tk"),
                                              F.explode("bands").alias("band")))
    many = spread.groupBy("band").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("band")
    mates = work.save("mates", spread.join(many, "band"))
    work.drop("spread")
    work.sweep()
    sources = mates.groupBy("node").agg(F.first("doc_id").alias("doc_id"), F.first("tk").alias("tk"))
    met = (keyed["doc_id"].eqNullSafe(sources["doc_id"])) & (keyed["tk"] == sources["tk"])
    bags = work.save("bags", keyed.join(sources, met).select("node", "text")
                     .mapInArrow(_sets(size), "node long, bag binary, n long, sketch binary").dropDuplicates(["node"]))
    members = work.save("members", mates.join(bags.select("node", "n", "sketch"), "node"))
    work.sweep()
    labels = None

    def labelled() -> DataFrame:
        return members.withColumn("label", F.col("node")) if labels is None else members.join(labels, "node")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        left, right = (bags.select(F.col("node").alias(x), F.col("bag").alias(f"bag_{x}")) for x in "ab")
        return work.save(name, pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b")
                         .mapInArrow(_overlap(threshold), "a long, b long, similarity double"))

    def merge(found: DataFrame, name: str) -> DataFrame | None:
        """(node, label) of all nodes once the classes at both ends of the links are one."""
        if found.isEmpty():
            return labels
        for end in "ab" if labels is not None else "":
            found = found.withColumnRenamed(end, "node").join(labels, "node").drop("node").withColumnRenamed("label", end)
        moved = components(found, work, name).select(F.col("node").alias("label"), F.col("label").alias("to"))
        now = bags.select("node", F.col("node").alias("label")) if labels is None else labels
        return work.save(name, now.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))

    for turn in range(rounds):
        if turn:  # several independent centres, which leave fewer classes apart
            ranks = [F.struct(F.xxhash64("node", F.lit(turn * centres + i)).alias("first"), "node", "n", "sketch") for i in range(centres)]
        else:
            ranks = [F.struct(F.col("doc_id").alias("first"), "node", "n", "sketch")]
        ranked = labelled().select("band", "label", F.posexplode(F.array(*ranks)).alias("try", "rank"))
        chosen = ranked.groupBy("band", "try", "label").agg(F.min("rank").alias("rank")) if turn else ranked
        centre = chosen.groupBy("band", "try").agg(F.min(F.struct("rank", "label")).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
        pairs = chosen.join(centre, ["band", "try"]).where("label <> c.label").select(
            F.least("rank.node", "c.rank.node").alias("a"), F.greatest("rank.node", "c.rank.node").alias("b"), F.col("rank.n").alias("n_a"),
            F.col("c.rank.n").alias("n_b"), F.col("rank.sketch").alias("sketch_a"), F.col("c.rank.sketch").alias("sketch_b"))
        pairs = pairs.mapInArrow(_possible(threshold), "a long, b long").distinct()
        found = verify(pairs, f"links{turn}")
        labels = merge(found, f"labels{turn}")
        work.sweep()
    now = labelled().select("band", "node", "label")
    mixed = now.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("band")
    apart = now.join(mixed, "band").select("node", "label").distinct()
    found = verify(candidates(apart.join(bags, "node").select("node", "label", "bag"), threshold).distinct(), "links-rest")
    work.sweep()
    labels = merge(found, "labels-rest")
    work.drop("bags")
    named = rows_.select("doc_id", "tk", "node")
    if labels is None:
        named = named.withColumn("label", F.col("node"))
    else:
        named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.select("doc_id", "tk", "label")
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "tk")
    classes = named.where("label is not null").groupBy("label").agg(
        F.min(order).alias("least"), F.count(F.lit(1)).alias("class_size"))
    return named.join(classes, "label", "left").select(
        "doc_id", "tk", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.col("label").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("tk") == F.col("least.tk")))).alias("first_of_class"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with the columns of ``docs``.

    Of repeated rows (one doc_id, one text) one stays; texts without words all stay, but for repeated
    rows. Null doc_ids are handled as in ``near_duplicates``.
    """
    stay = near_duplicates(docs, threshold).where("first_of_class").select(
        F.col("doc_id").alias("__doc"), F.col("tk").alias("__tk")).distinct()
    met = F.col("doc_id").eqNullSafe(F.col("__doc")) & text_key().eqNullSafe(F.col("__tk"))
    one = W.partitionBy("__doc", "__tk").orderBy(F.lit(0))
    return docs.join(stay, met).withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*docs.columns)

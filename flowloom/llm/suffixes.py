"""Removal of repeated byte strings by a hash-compared suffix sort (operator 4).

Only suffixes at anchors are sorted: every window of ``width`` bytes has an anchor, its least byte gram, and
equal windows have it at the same place. Documents are dealt to blocks, anchors to buckets; a block sends a
bucket each anchor once, so a string that a third of all documents hold costs one entry a block.

1. Buckets tell the blocks which of their anchors occur in two documents.
2. Blocks send these with the bytes around them. A bucket sorts the suffixes that start at one anchor by
   mergesort; two suffixes are compared through their common extension, found by binary search over prefix
   polynomial hashes. Common extensions of neighbours to the right and hashes to the left give the
   windows that are equal, whose bytes are then compared, and their least doc_id goes back.
3. Blocks cut the windows whose least doc_id is smaller than the document's.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import hashing as H
from flowloom.llm.storage import Workspace, partitions, text_key

WIDTH, GRAM = 50, 16
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 18 << 20
_PIECE = 4 << 20
_COLLISION = "two byte strings have one hash"


class _Shape:
    """Sizes that all steps share."""

    def __init__(self, width: int, k: int, buckets: int, seed: int):
        self.width, self.k, self.buckets, self.seed = width, k, buckets, seed
        self.longest = 2 * width - k


def _runs(table: pa.Table, s: _Shape, context: bool = False):
    """Runs of windows of a block: row, first window, windows, place of the anchor, gram, context hash.

    With ``context``, also the bytes of each run. Rows with a null doc_id have no runs.
    """
    codes = H.byte_codes(s.seed)
    rows, starts, pieces = [], [], []
    for row, (doc, text) in enumerate(zip(table["doc_id"].to_pylist(), table["text"].to_pylist())):
        if doc is None or not text:
            continue
        data = text.encode()
        for at in range(0, max(1, len(data) - s.width + 1), _PIECE):
            rows.append(row)
            starts.append(at)
            pieces.append(data[at:at + _PIECE + s.width - 1])
    out = []
    for a, b in H.pack(pieces):
        data = np.frombuffer(b"".join(pieces[a:b]), np.uint8)
        offsets = np.cumsum([0] + [len(x) for x in pieces[a:b]])
        values = codes[data]
        item, low, high, place, gram = H.super_grams(values, offsets, s.k, s.width)
        if not len(item):
            continue
        pre = H.prefix(values)
        mark = H.mix(H.span(pre, low, high + s.width) + (place - low + 1000 * (high - low)).astype(H.U) * H.U(0xE7037ED1A0B428DB))
        shift = np.array(starts[a:b])[item] - offsets[item]
        part = [np.array(rows[a:b])[item], low + shift, high - low + 1, place - low, gram, mark]
        if context:
            at = low[:, None] + np.arange(s.longest)
            part.append(np.where(at < (high + s.width)[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8))
        out.append(part)
    if not out:
        empty = np.zeros(0, np.int64)
        return [empty] * 4 + [empty.astype(H.U)] * 2 + ([np.zeros((0, s.longest), np.uint8)] if context else [])
    return [np.concatenate(x) for x in zip(*out)]


def _docs(table: pa.Table, row: np.ndarray) -> np.ndarray:
    return np.array([x if x is not None else 0 for x in table["doc_id"].to_pylist()], np.int64)[row]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Starts of the stretches of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate(([True], change)))


def _bucketed(gram: np.ndarray, s: _Shape):
    """Order by bucket and gram, the buckets met, and their bounds in that order."""
    bucket = (H.mix(gram + H.U(5)) % H.U(s.buckets)).astype(np.int64)
    order = np.lexsort((gram, bucket))
    first = _firsts(bucket[order])
    return order, bucket[order][first].tolist(), np.append(first, len(gram)).tolist()


def _anchors(s: _Shape):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("grams", pa.binary()), ("twice", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        row, _, _, _, gram, _ = _runs(table, s)
        doc = _docs(table, row)
        order = np.argsort(gram)
        gram, doc = gram[order], doc[order]
        first = _firsts(gram)
        if not len(first):
            return schema.empty_table()
        twice = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        gram = gram[first]
        order, buckets, bounds = _bucketed(gram, s)
        gram, twice = gram[order], twice[order]
        cut = list(zip(bounds[:-1], bounds[1:]))
        return pa.table([pa.array(buckets, pa.int32()), pa.array([key[0].as_py()] * len(cut), pa.int32()),
                         pa.array([gram[a:b].tobytes() for a, b in cut], pa.binary()),
                         pa.array([np.packbits(twice[a:b]).tobytes() for a, b in cut], pa.binary())], schema=schema)

    return run


def _shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each block of a bucket, which of its anchors occur in two documents."""
    grams = [np.frombuffer(x, H.U) for x in table["grams"].to_pylist()]
    sizes = [len(x) for x in grams]
    gram = np.concatenate(grams)
    again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["twice"].to_pylist(), sizes)])
    order = np.argsort(gram)
    first = _firsts(gram[order])
    count = np.diff(np.append(first, len(gram)))
    flags = np.zeros(len(gram), bool)
    flags[order] = np.repeat((count > 1) | (np.maximum.reduceat(again[order], first) > 0), count)
    bounds = np.cumsum([0] + sizes)
    return pa.table({"block": table["block"], "bucket": table["bucket"],
                     "bits": pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())})


_ENTRY = [("gram", H.U), ("mark", H.U), ("doc", np.int64), ("left", np.uint8), ("n", np.uint8)]


def _pressed(entries: np.ndarray) -> bytes:
    """Column after column, compressed: the bytes around anchors are text."""
    return zlib.compress(b"".join(np.ascontiguousarray(entries[f]).tobytes() for f in entries.dtype.names), 1)


def _unpressed(blob: bytes, kind: np.dtype) -> np.ndarray:
    data, at = zlib.decompress(blob), 0
    out = np.empty(len(data) // kind.itemsize, kind)
    for f in kind.names:
        size = kind[f].itemsize * len(out)
        out[f] = np.frombuffer(data, kind[f].base, size // kind[f].base.itemsize, at).reshape(out[f].shape)
        at += size
    return out


def _contexts(s: _Shape):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("entries", pa.binary())])
    kind = np.dtype([*_ENTRY, ("bytes", np.uint8, (s.longest,))])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table) or not len(replies):
            return schema.empty_table()
        row, low, n, left, gram, mark, data = _runs(table, s, True)
        doc = _docs(table, row)
        known = np.unique(gram)
        order, buckets, bounds = _bucketed(known, s)
        bits = dict(zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist()))
        hit = np.zeros(len(known), bool)
        for bucket, a, b in zip(buckets, bounds[:-1], bounds[1:]):
            hit[order[a:b]] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=b - a)
        use = np.flatnonzero(hit[np.searchsorted(known, gram)])
        use = use[np.lexsort((doc[use], mark[use], gram[use]))]
        first = _firsts(gram[use], mark[use])
        same = np.ones(len(use), bool)
        same[first] = False
        same = np.flatnonzero(same)
        if (data[use[same]] != data[use[same - 1]]).any():
            raise ValueError(_COLLISION)
        use = use[first]
        out = np.empty(len(use), kind)
        for name, values in (("gram", gram), ("mark", mark), ("doc", doc), ("left", left), ("n", n), ("bytes", data)):
            out[name] = values[use]
        order, buckets, bounds = _bucketed(out["gram"], s)
        out = out[order]
        cut = list(zip(bounds[:-1], bounds[1:]))
        return pa.table([pa.array(buckets, pa.int32()), pa.array([key[0].as_py()] * len(cut), pa.int32()),
                         pa.array([_pressed(out[a:b]) for a, b in cut], pa.binary())], schema=schema)

    return run


class Suffixes:
    """Suffixes at ``start`` of rows of bytes, compared through prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int):
        self.data, self.start, self.size = data, start.astype(np.int64), (end - start).astype(np.int64)
        width = data.shape[1]
        pre = np.zeros((len(data), width + 1), H.U)
        np.cumsum(H.byte_codes(seed + 77)[data] * H.powers(width), axis=1, out=pre[:, 1:])
        self.pre, self.back = pre, H.powers(width + 1, True)

    def hash(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.pre[rows, b] - self.pre[rows, a]) * self.back[a]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes ``x`` and ``y``, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        ax, ay = self.start[x], self.start[y]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hash(x, ax, ax + mid) == self.hash(y, ay, ay + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether ``x`` sorts before ``y``; equal suffixes give ``ties``."""
        n = self.common(x, y)
        x_ends, y_ends = n == self.size[x], n == self.size[y]
        top = self.data.shape[1] - 1
        less = self.data[x, np.minimum(self.start[x] + n, top)] < self.data[y, np.minimum(self.start[y] + n, top)]
        return np.where(x_ends & y_ends, ties, np.where(x_ends, True, np.where(y_ends, False, less)))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes inside each group; groups are stretches of equal numbers.

        Neighbouring runs of one group merge by each suffix's binary search in the other run.
        """
        order = np.arange(len(group))
        first = _firsts(group)
        count = np.diff(np.append(first, len(group)))
        base, until = np.repeat(first, count), np.repeat(first + count, count)
        size = 1
        while len(count) and size < count.max():
            at = np.flatnonzero(until - base > size)
            own = base[at] + (at - base[at]) // size * size
            right = ((own - base[at]) // size) % 2 == 1
            low = np.where(right, own - size, np.minimum(own + size, until[at]))
            high = np.where(right, own, np.minimum(own + 2 * size, until[at]))
            begin, target = low.copy(), at - own + np.where(right, own - size, own)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                past = self.before(order[mid], order[at[open_]], right[open_])
                low[open_], high[open_] = np.where(past, mid + 1, low[open_]), np.where(past, high[open_], mid)
            merged = order.copy()
            merged[target + low - begin] = order[at]
            order, size = merged, size * 2
        return order


def equal_windows(suffixes: Suffixes, group: np.ndarray, left: np.ndarray, n: np.ndarray, doc: np.ndarray, width: int,
                  reach: int) -> np.ndarray:
    """Least doc of every window of every row: [row, window]; windows are equal only inside a group."""
    order = suffixes.sort(group)
    shared = np.zeros(len(order), np.int64)
    same = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
    shared[same] = suffixes.common(order[same], order[same - 1])
    out = np.full((len(group), reach), np.iinfo(np.int64).max)
    left, n = left.astype(np.int64), n.astype(np.int64)
    for o in range(reach):
        stretch = np.cumsum(shared < width - o)
        at = np.flatnonzero((left[order] >= o) & (left[order] - o < n[order]))
        rows = order[at]
        before = suffixes.hash(rows, left[rows] - o, left[rows])
        by = np.lexsort((before, stretch[at]))
        rows = rows[by]
        first = _firsts(stretch[at][by], before[by])
        if not len(first):
            continue
        inner = np.ones(len(rows), bool)
        inner[first] = False
        inner = np.flatnonzero(inner)
        window = lambda r: suffixes.data[r[:, None], (left[r] - o)[:, None] + np.arange(width)]
        for i in range(0, len(inner), 1 << 17):
            part = inner[i:i + (1 << 17)]
            if (window(rows[part]) != window(rows[part - 1])).any():
                raise ValueError(_COLLISION)
        out[rows, left[rows] - o] = np.repeat(np.minimum.reduceat(doc[rows], first), np.diff(np.append(first, len(rows))))
    return out


def _resolve(s: _Shape):
    kind = np.dtype([*_ENTRY, ("bytes", np.uint8, (s.longest,))])
    piece = np.dtype([("gram", H.U), ("mark", H.U), ("doc", np.int64), ("first", np.uint8), ("last", np.uint8)])
    reach = s.width - s.k + 1

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [_unpressed(x, kind) for x in table["entries"].to_pylist()]
        block = np.repeat(table["block"].to_numpy(), [len(x) for x in parts])
        entries = np.concatenate(parts)
        order = np.lexsort((entries["doc"], entries["mark"], entries["gram"]))
        entries, block = entries[order], block[order]
        first = _firsts(entries["gram"], entries["mark"])
        same = np.ones(len(entries), bool)
        same[first] = False
        same = np.flatnonzero(same)
        if (entries["bytes"][same] != entries["bytes"][same - 1]).any():
            raise ValueError(_COLLISION)
        variant = np.cumsum(np.isin(np.arange(len(entries)), first, assume_unique=True)) - 1
        own = entries[first]  # the least doc of each (gram, mark) comes first
        head = _firsts(own["gram"])
        count = np.diff(np.append(head, len(own)))
        group = np.repeat(np.arange(len(head)), count)
        least = np.repeat(own["doc"][:, None], reach, 1)
        many = np.flatnonzero(count[group] > 1)
        if len(many):
            v = own[many]
            found = Suffixes(v["bytes"], v["left"], v["n"].astype(np.int64) + s.width - 1, s.seed)
            least[many] = equal_windows(found, group[many], v["left"], v["n"], v["doc"], s.width, reach)
        # Stretches of windows with one least doc.
        inside = np.arange(reach)[None, :] < own["n"][:, None]
        at = np.flatnonzero(inside.ravel())
        line, value = at // reach, least.ravel()[at]
        cut = _firsts(line, value)
        end = np.append(cut[1:], len(at)) - 1
        pieces = np.empty(len(cut), piece)
        for name, values in (("gram", own["gram"][line[cut]]), ("mark", own["mark"][line[cut]]), ("doc", value[cut]),
                             ("first", at[cut] % reach), ("last", at[end] % reach)):
            pieces[name] = values
        start = np.searchsorted(line[cut], np.arange(len(own) + 1))
        by = np.lexsort((variant, block))
        block, variant = block[by], variant[by]
        stretch = _firsts(block)
        rows = []
        for a, b in zip(stretch, np.append(stretch[1:], len(block))):
            take, _ = H.ranges(start[:-1][variant[a:b]], (start[1:] - start[:-1])[variant[a:b]])
            rows.append(pieces[take].tobytes())
        return pa.table({"block": pa.array(block[stretch], pa.int32()), "pieces": pa.array(rows, pa.binary())})

    return run


def _cut(s: _Shape, names: list[str]):
    piece = np.dtype([("gram", H.U), ("mark", H.U), ("doc", np.int64), ("first", np.uint8), ("last", np.uint8)])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        texts = [(x or "").encode() for x in table["text"].to_pylist()]
        bounds = np.cumsum([0] + [len(x) + 1 for x in texts])
        change = np.zeros(int(bounds[-1]) + 1, np.int32)
        if len(found):
            pieces = np.concatenate([np.frombuffer(x, piece) for x in found["pieces"].to_pylist()])
            pieces = pieces[np.lexsort((pieces["first"], pieces["mark"], pieces["gram"]))]
            head = _firsts(pieces["gram"], pieces["mark"])
            size = np.diff(np.append(head, len(pieces)))
            row, low, _, _, gram, mark = _runs(table, s)
            doc = _docs(table, row)
            # The pair (gram, mark) of every run, looked up among the pieces.
            pair = np.dtype([("gram", H.U), ("mark", H.U)])
            wanted = np.empty(len(gram), pair)
            wanted["gram"], wanted["mark"] = gram, mark
            names_ = np.empty(len(head), pair)
            names_["gram"], names_["mark"] = pieces["gram"][head], pieces["mark"][head]
            near = np.minimum(np.searchsorted(names_["gram"], gram), max(0, len(head) - 1))
            some = np.flatnonzero(names_["gram"][near] == gram)
            group = np.searchsorted(names_, wanted[some])
            group = np.minimum(group, len(head) - 1)
            good = names_[group] == wanted[some]
            some, group = some[good], group[good]
            take, owner = H.ranges(head[group], size[group])
            run_ = some[owner]
            gone = pieces["doc"][take] < doc[run_]
            take, run_ = take[gone], run_[gone]
            base = bounds[row[run_]] + low[run_]
            np.add.at(change, base + pieces["first"][take], 1)
            np.add.at(change, base + pieces["last"][take] + s.width, -1)
        covered = np.cumsum(change[:-1]) > 0
        kept, removed, spans = [], [], []
        for text, a in zip(texts, bounds):
            gone = covered[a:a + len(text)]
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if removed[-1] else text)
        out = {n: table[n] for n in names}
        out |= {"kept_bytes": pa.array(kept, pa.binary()), "n_bytes": pa.array([len(x) for x in texts], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
        return pa.table(out)

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, k: int = GRAM) -> DataFrame:
    """``docs`` with kept_bytes, n_bytes, n_removed and n_spans; given columns of these names are replaced.

    Texts are UTF-8 bytes, null counts as empty. A byte goes if a string of ``width`` bytes around it also
    starts in a document with a smaller doc_id; n_spans counts the maximal removed runs. Rows with a
    null doc_id are compared with nothing; rows that share a doc_id never cut each other. Repeated rows
    are cut alike. An empty table gives an empty table. ``k`` is a power of two. Blocks and
    buckets are counted from the bytes of all texts, so each stays near BLOCK_BYTES and BUCKET_BYTES;
    a bucket holds an anchor once a block. Should two strings have one hash, all is done again with another seed.
    """
    docs = docs.drop("kept_bytes", "n_bytes", "n_removed", "n_spans", "__block")
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "suffixes")
    total = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, seed = partitions(spark, total, BLOCK_BYTES), 1
    dealt = docs.withColumn("__block", F.pmod(F.xxhash64("doc_id", text_key()), F.lit(blocks)).cast("int"))
    usable = dealt.where("doc_id is not null and text is not null").select("__block", "doc_id", "text")
    while True:
        s = _Shape(width, k, partitions(spark, total, BUCKET_BYTES), seed)
        try:
            anchors = usable.groupBy("__block").applyInArrow(_anchors(s), "bucket int, block int, grams binary, twice binary")
            replies = work.save(f"replies{seed}", anchors.groupBy("bucket").applyInArrow(_shared, "block int, bucket int, bits binary"))
            work.sweep()
            contexts = usable.groupBy("__block").cogroup(replies.groupBy("block")).applyInArrow(
                _contexts(s), "bucket int, block int, entries binary")
            pieces = work.save(f"pieces{seed}", contexts.groupBy("bucket").applyInArrow(_resolve(s), "block int, pieces binary"))
            work.sweep()
            break
        except PythonException as error:
            if _COLLISION not in str(error):
                raise
            seed += 1
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return dealt.groupBy("__block").cogroup(pieces.groupBy("block")).applyInArrow(
        _cut(s, docs.columns), f"{kinds}, kept_bytes binary, n_bytes long, n_removed long, n_spans long")

"""Substring removal by de Bruijn compaction (operator 3).

Windows of ``width`` words are the edges of a de Bruijn graph whose nodes are the ``width - 1`` words
two neighbouring windows share. Windows with the same least word gram form one pre-compacted edge,
as in minimiser-based graph builders; a text that goes round one such edge has one row for all its
rounds, so a periodic text is no longer than others. Spark joins keep the edges whose gram occurs in two documents,
find each edge's first source, merge edges that meet in a node without branches into one path, and
compare the words at both source coordinates of every path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowloom.llm import hashing as H
from flowloom.llm.storage import Workspace, text_key

WIDTH, GRAM = 50, 8
_KEY = ["doc_id", "tk"]


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _context(pre, low, high, place, width):
    """Hash of all words of a run of windows and of the gram's place in them."""
    return H.mix(H.span(pre, low, high + width) + (place - low + 1000 * (high - low)).astype(H.U) * H.U(0xE7037ED1A0B428DB))


def _edges(width: int, k: int, seed: int):
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int32()), ("gram", pa.int64()), ("context", pa.int64()),
                        ("head", pa.int64()), ("tail", pa.int64()), ("low", pa.int32()), ("n", pa.int32()), ("times", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode() for x in batch["text"].to_pylist()]
            ids, tks = batch["doc_id"].to_numpy(), batch["tk"].to_numpy()
            for a, b in H.pack(texts):
                words, offsets = H.word_hashes(texts[a:b], seed)
                item, low, high, place, gram = H.super_grams(words, offsets, k, width)
                if not len(item):
                    continue
                pre = H.prefix(words)
                context = _context(pre, low, high, place, width)
                # Runs of a text lie end to end, so the rounds of one edge are ``n`` windows apart.
                same = (item[1:] == item[:-1]) & (gram[1:] == gram[:-1]) & (context[1:] == context[:-1]) & (
                    high[1:] - low[1:] == high[:-1] - low[:-1])
                first = np.flatnonzero(np.concatenate(([True], ~same)))
                times = np.diff(np.concatenate((first, [len(item)])))
                item, low, high, gram, context = (x[first] for x in (item, low, high, gram, context))
                yield pa.record_batch([
                    ids[a:b][item], tks[a:b][item], _signed(gram), _signed(context),
                    _signed(H.mix(H.span(pre, low, low + width - 1))),
                    _signed(H.mix(H.span(pre, high + 1, high + width))),
                    (low - offsets[item]).astype(np.int32), (high - low + 1).astype(np.int32), times.astype(np.int32)], schema=schema)

    return run


def _windows(width: int, seed: int):
    """Hashes of the single windows of the runs named in ``wanted``."""
    schema = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("o", pa.int32()), ("window", pa.int64()),
                        ("doc_id", pa.int64()), ("tk", pa.int32()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, doc, tk, wanted in zip(*(batch[c].to_pylist() for c in ("text", "doc_id", "tk", "wanted"))):
                words, _ = H.word_hashes([text.encode()], seed)
                low, n = (np.array([w[c] for w in wanted]) for c in ("low", "n"))
                at, owner = H.ranges(low, n)
                pre = H.prefix(words)
                yield pa.record_batch([
                    np.array([w["gram"] for w in wanted])[owner], np.array([w["context"] for w in wanted])[owner],
                    (at - low[owner]).astype(np.int32), _signed(H.mix(H.span(pre, at, at + width))),
                    np.full(len(at), doc), np.full(len(at), tk, np.int32), at.astype(np.int32)], schema=schema)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the asked stretches under their source coordinates, each once a batch."""
    schema = pa.schema([("src_doc", pa.int64()), ("src_tk", pa.int32()), ("src_a", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])
    for batch in batches:
        out = set()
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
            words = text.encode().split()
            out.update((s["src_doc"], s["src_tk"], s["src_a"], s["b"] - s["a"], hashlib.md5(b" ".join(words[s["a"] + i:s["b"] + i])).digest())
                       for s in spans for i in range(0, s["times"] * s["step"], s["step"]))
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept words of each row; words are what ``bytes.split`` finds between ASCII white space."""
    for batch in batches:
        kept, total, removed = [], [], []
        for text, spans in zip(batch["text"].to_pylist(), batch["__spans"].to_pylist()):
            words = (text or "").encode().split()
            keep = np.ones(len(words), bool)
            for s in spans or ():
                # A round is no longer than a window, so all rounds together leave no word between them.
                keep[s["a"]:s["b"] + (s["times"] - 1) * s["step"]] = False
            gone = len(words) - int(keep.sum())
            total.append(len(words))
            removed.append(gone)
            kept.append((b" ".join([w for w, k in zip(words, keep) if k] if gone else words)).decode())
        rest = [(n, batch[n]) for n in batch.schema.names if n != "__spans"]
        rest += [("kept_text", pa.array(kept, pa.string())), ("n_words", pa.array(total, pa.int64())),
                 ("n_removed", pa.array(removed, pa.int64()))]
        yield pa.record_batch([c for _, c in rest], names=[n for n, _ in rest])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tk", text_key())


def repeated_paths(docs: DataFrame, work: Workspace, width: int = WIDTH, k: int = GRAM, seed: int = 1) -> DataFrame:
    """Compacted repeated paths: (doc_id, tk, a, b) words and their first source (src_doc, src_tk, src_a).

    A path found ``times`` over, each ``step`` words behind the one before, is one row with the first one's words.

    ``docs`` needs doc_id, tk and text, none null. Every window covered by a path also starts in the
    source, a document with a smaller doc_id; the source is the smallest such document.
    """
    edges = docs.mapInArrow(_edges(width, k, seed), "doc_id long, tk int, gram long, context long, head long, tail long, low int, n int, times int")
    twice = (edges.groupBy("gram").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
             .where("x < y").select("gram"))
    shared = work.save(f"shared{seed}", edges.join(twice, "gram"))
    work.sweep()
    first = work.save(f"first{seed}", shared.groupBy("gram", "context").agg(
        F.min(F.struct("doc_id", "tk", "low")).alias("src"), F.first("n").alias("n"),
        F.first("head").alias("head"), F.first("tail").alias("tail")))
    variants = first.groupBy("gram").agg(F.count(F.lit(1)).alias("v"))
    marked = first.join(variants, "gram")
    whole = marked.where("v = 1").select("gram", "context", F.lit(0).alias("o1"), (F.col("n") - 1).alias("o2"),
                                         F.col("src.doc_id").alias("src_doc"), F.col("src.tk").alias("src_tk"),
                                         F.col("src.low").alias("src_a"))
    wanted = (marked.where("v > 1").groupBy(F.col("src.doc_id").alias("doc_id"), F.col("src.tk").alias("tk"))
              .agg(F.collect_list(F.struct("gram", "context", F.col("src.low").alias("low"), "n")).alias("wanted")))
    windows = work.save(f"windows{seed}", docs.join(wanted, _KEY).select("doc_id", "tk", "text", "wanted").mapInArrow(
        _windows(width, seed), "gram long, context long, o int, window long, doc_id long, tk int, at int"))
    work.sweep()
    best = windows.groupBy("window").agg(F.min(F.struct("doc_id", "tk", "at")).alias("src"))
    placed = windows.select("gram", "context", "o", "window").join(best, "window").select(
        "gram", "context", "o", F.col("src.doc_id").alias("src_doc"), F.col("src.tk").alias("src_tk"),
        (F.col("src.at") - F.col("o")).alias("shift"))
    island = W.partitionBy("gram", "context", "src_doc", "src_tk", "shift").orderBy("o")
    parts = (placed.withColumn("island", F.col("o") - F.row_number().over(island))
             .groupBy("gram", "context", "src_doc", "src_tk", "shift", "island")
             .agg(F.min("o").alias("o1"), F.max("o").alias("o2"))
             .select("gram", "context", "o1", "o2", "src_doc", "src_tk", (F.col("shift") + F.col("o1")).alias("src_a")))
    # A node is passed without branching if one edge leads in and one leads out.
    ends = first.select(F.col("head").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")).unionAll(
        first.select(F.col("tail").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")))
    plain = ends.groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out")).where("into = 1 and out = 1")
    through = first.join(plain.select(F.col("node").alias("tail"), F.lit(True).alias("plain")), "tail", "left").select(
        "gram", "context", "plain")
    pieces = whole.unionByName(parts).join(through, ["gram", "context"])
    spans = shared.join(pieces, ["gram", "context"]).where("src_doc < doc_id").select(
        *_KEY, (F.col("low") + F.col("o1")).alias("a"), (F.col("low") + F.col("o2") + width).alias("b"),
        "src_doc", "src_tk", "src_a", (F.coalesce("plain", F.lit(False)) & (F.col("o2") == F.col("n") - 1)).alias("plain"),
        "times", F.col("n").alias("step"))
    order = W.partitionBy(*_KEY).orderBy("a", "b")
    glued = spans.withColumn("glue", F.lag("plain").over(order) & (F.lag("src_doc").over(order) == F.col("src_doc"))
                             & (F.lag("src_tk").over(order) == F.col("src_tk"))
                             & (F.lag(F.col("src_a") - F.col("a")).over(order) == F.col("src_a") - F.col("a"))
                             & (F.lag("b").over(order) == F.col("a") + width - 1)
                             & (F.col("times") == 1) & (F.lag("times").over(order) == 1))
    numbered = glued.withColumn("path", F.sum(F.when(F.coalesce("glue", F.lit(False)), 0).otherwise(1)).over(order))
    return work.save(f"paths{seed}", numbered.groupBy(*_KEY, "path", "src_doc", "src_tk").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.min("src_a").alias("src_a"), F.max("times").alias("times"),
        F.max("step").alias("step")).drop("path"))


def _verified(docs: DataFrame, paths: DataFrame) -> bool:
    """Whether all copies of a path have the words at its source coordinates."""
    source = paths.select(F.col("src_doc").alias("doc_id"), F.col("src_tk").alias("tk"), F.col("src_a").alias("a"),
                          (F.col("src_a") + F.col("b") - F.col("a")).alias("b"), "src_doc", "src_tk", "src_a",
                          F.lit(1).alias("times"), F.lit(1).alias("step")).distinct()
    asked = paths.select(*source.columns).unionAll(source).groupBy(*_KEY).agg(
        F.collect_list(F.struct("a", "b", "src_doc", "src_tk", "src_a", "times", "step")).alias("spans"))
    digests = docs.join(asked, _KEY).select("text", "spans").mapInArrow(
        _digests, "src_doc long, src_tk int, src_a int, n int, digest binary")
    wrong = digests.groupBy("src_doc", "src_tk", "src_a", "n").agg(
        F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y")
    return wrong.limit(1).count() == 0


def remove_repeats(docs: DataFrame, width: int = WIDTH, k: int = GRAM) -> DataFrame:
    """``docs`` with kept_text, n_words and n_removed; all given columns stay.

    Words are runs of characters other than ASCII white space. A word goes if a window of ``width``
    words around it also starts in a document with a smaller doc_id. Null text counts as no words and
    gives an empty kept_text; rows with a null doc_id are compared with nothing and keep all words.
    Rows that share a doc_id never remove each other's words. An empty table gives an empty table.
    Given columns named kept_text, n_words or n_removed are replaced.
    If words at the two ends of a path differ (a hash collision), all is done again with another seed.
    """
    docs = docs.drop("__spans", "kept_text", "n_words", "n_removed")
    work = Workspace(docs.sparkSession, "substring")
    usable = _keyed(docs.select("doc_id", "text").where("doc_id is not null and text is not null"))
    seed = 1
    while True:
        paths = repeated_paths(usable, work, width, k, seed)
        work.sweep()
        if _verified(usable, paths):
            break
        seed += 1
    work.sweep()
    spans = paths.groupBy(F.col("doc_id").alias("__doc"), F.col("tk").alias("__tk")).agg(
        F.collect_list(F.struct("a", "b", "times", "step")).alias("__spans"))
    met = (F.col("doc_id") == F.col("__doc")) & (text_key() == F.col("__tk"))
    marked = docs.join(spans, met, "left").select(*docs.columns, "__spans")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return marked.mapInArrow(_cut, f"{kinds}, kept_text string, n_words long, n_removed long")

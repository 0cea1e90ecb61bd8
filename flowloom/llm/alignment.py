"""Tokens of two tokenizers aligned by interval coalescing (operator 13).

Every token covers a byte range of one text. All tokens of both tokenizers, sorted by start, are swept with the
running maximum of their ends; a group ends where a start reaches that maximum. Inside a group each token of A is
linked with each of B. How many documents link a pair of ids is counted over the whole corpus, and every document
is told how well its own links agree with the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.storage import Workspace

#: Characters of texts handled at once in a task; a longer text is handled alone.
SLICE = 1 << 17
#: Links of a group up to which they are simply listed; in larger groups equal ids are folded first.
LISTED = 64
#: Links expanded at once.
EXPAND = 1 << 20
#: Of R (document, pair) rows only HEAVY pairs can have R / HEAVY rows or more; their table is broadcast.
HEAVY = 1 << 16
B_BITS = 24
#: Fixed value: how the byte-level pre-tokenizer cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space from which the faster library may run out of stack.
LONG_SPACE = re.compile(r"\s{5000}")


def _byte_level() -> dict[str, int]:
    """Byte of each letter of the byte-level alphabet: printable bytes stand for themselves, the rest from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level tokenizer file; the text gets a leading space.

    Where the file's merges come in the order of their ids and its words are cut by ``WORDS``, the same vocabulary is run by
    the faster ``tiktoken``, which gives the same ids; tests hold both against each other.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(raw)
        self.tokenizer.encode_special_tokens = True
        letters = _byte_level()
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.fast = self._ranked(json.loads(raw))

    def _ranked(self, file: dict):
        model, words = file["model"], file.get("pre_tokenizer") or {}
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", ())]
        plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and not file.get("normalizer")
        if not plain or model.get("ignore_merges") or merged != list(range(256, 256 + len(merged))):
            return None
        import tiktoken

        ranks = {self.bytes[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merged) else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if self.fast is None or (len(text) > 5000 and LONG_SPACE.search(text)):
                found = self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
                out.append(np.array(found, np.int64))
            else:
                out.append(self.fast.encode_to_numpy(" " + text).astype(np.int64))
        return out


class PieceBpe:
    """A piece model with byte fallback that adds the leading space itself."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i)
                      else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Group number of each interval: sorted by start, a group breaks where a start reaches the running maximum end."""
    order = np.lexsort((start,))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(sorted_keys)))


def _folded(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys folded with their weights added up (1 each if none are given), in the order of the keys."""
    if weight is None:
        key = np.sort(key)
        start, n = _runs(key)
        return key[start], n
    order = np.argsort(key, kind="stable")
    start, _ = _runs(key[order])
    return key[order][start], np.add.reduceat(weight[order], start) if len(start) else weight[:0]


def _expanded(first_a, n_a, first_b, n_b, of_a, of_b, head) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, place in A, place in B) of all pairs of each group, some ``EXPAND`` at a time; ``head`` is a group's key part."""
    width = np.repeat(n_b, n_a)
    a = np.arange(len(width)) + np.repeat(first_a - np.concatenate([[0], np.cumsum(n_a)[:-1]]) if len(n_a) else n_a, n_a)
    first, head = np.repeat(first_b, n_a), np.repeat(head, n_a)
    done, row = np.concatenate([[0], np.cumsum(width)]), 0
    while row < len(width):
        stop = max(row + 1, int(np.searchsorted(done, done[row] + EXPAND, "right")) - 1)
        w = width[row:stop]
        left = np.repeat(a[row:stop], w)
        right = np.arange(done[row], done[stop]) + np.repeat(first[row:stop] - done[row:stop], w)
        yield np.repeat(head[row:stop], w) | (of_a[left] << B_BITS) | of_b[right], left, right
        row = stop


def linked_pairs(ids_a, in_a, ids_b, in_b, group_doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair key, links) of all documents, each pair of a document once, in order.

    ``in_a`` and ``in_b`` are the tokens of each group. Links of small groups are listed and counted. In larger ones equal
    ids of a side are folded before the sides meet. About ``EXPAND`` pairs, or those of one id, are held before they
    are folded by document.
    """
    if not len(group_doc):
        return (np.zeros(0, np.int64),) * 3
    docs, local = np.unique(group_doc, return_inverse=True)
    if len(docs) >= 1 << 63 - 2 * B_BITS:
        raise ValueError("too many documents in one slice")
    head = local.astype(np.int64) << 2 * B_BITS
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    small = in_a * in_b <= LISTED
    held = [_folded(key) for key, _, _ in _expanded(*(x[small] for x in (first_a, in_a, first_b, in_b)), ids_a, ids_b, head[small])]
    if not small.all():
        sides = []
        for ids, n in ((ids_a, in_a), (ids_b, in_b)):
            group = np.repeat(np.arange(len(n)), n)
            key, times = _folded((group << B_BITS | ids)[~small[group]])
            distinct = np.bincount(key >> B_BITS, minlength=len(n))
            sides.append((key & ((1 << B_BITS) - 1), times, np.cumsum(distinct) - distinct, distinct))
        (ia, ta, fa, na), (ib, tb, fb, nb) = sides
        for key, left, right in _expanded(fa, na, fb, nb, ia, ib, head):
            held.append(_folded(key, ta[left] * tb[right]))
    key, links = held[0] if len(held) == 1 else _folded(*(np.concatenate(x) for x in zip(*held)))
    return docs[key >> 2 * B_BITS], key & ((1 << 2 * B_BITS) - 1), links


class Aligner:
    """Both tokenizers with the lengths and printed ids of their tokens."""

    def __init__(self, raw_a: bytes, raw_b: bytes):
        self.a, self.b = ByteBpe(raw_a), PieceBpe(raw_b)
        self.size_a, self.size_b = (np.array([len(t) for t in x.bytes], np.int64) for x in (self.a, self.b))
        self.bytes_a, self.bytes_b = np.empty(len(self.size_a), object), np.empty(len(self.size_b), object)
        self.bytes_a[:], self.bytes_b[:] = self.a.bytes, self.b.bytes
        # An id is printed with what follows it: "," inside a side, "|" after A's last, ";" after B's last of a group.
        self.shown = np.array([f"{i}{mark}" for n, marks in ((len(self.size_a), ",|"), (len(self.size_b), ",;"))
                               for mark in marks for i in range(n)], object)

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both tokenizers; none where the joined bytes of either differ from space and text."""
        out, none = [], np.zeros(0, np.int64)
        for text, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            whole = b" " + text.encode("utf-8", "surrogatepass")
            same = text and b"".join(self.bytes_a[a].tolist()) == whole and b"".join(self.bytes_b[b].tolist()) == whole
            out.append((a, b) if same else (none, none))
        return out

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """Per text: counts, printed groups, and its pairs with their numbers of links (``pair_ends`` cuts them by text)."""
        tokens = self.tokens(texts)
        n_a, n_b = (np.array([len(t[i]) for t in tokens], np.int64) for i in (0, 1))
        ids_a, ids_b = (np.concatenate([t[i] for t in tokens]) for i in (0, 1))
        ends = [np.cumsum(size[ids]) for size, ids in ((self.size_a, ids_a), (self.size_b, ids_b))]
        starts = [end - size[ids] for end, size, ids in zip(ends, (self.size_a, self.size_b), (ids_a, ids_b))]
        group = coalesce(np.concatenate(starts), np.concatenate(ends))
        group_a, group_b = group[:len(ids_a)], group[len(ids_a):]
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        first_a, in_a = _runs(group_a)
        _, in_b = _runs(group_b)
        group_doc = doc_a[first_a]
        n_groups = np.bincount(group_doc, minlength=len(texts))
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, group_doc, in_a * in_b)
        doc, pair, links = linked_pairs(ids_a, in_a, ids_b, in_b, group_doc)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "pairs": pair, "links": links,
                "pair_ends": np.searchsorted(doc, np.arange(len(texts) + 1)),
                "groups": self._printed(ids_a, group_a, in_a, ids_b, group_b, in_b, n_a + n_b)}

    def _printed(self, ids_a, group_a, in_a, ids_b, group_b, in_b, n_tokens) -> list[str]:
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        va, vb = len(self.size_a), len(self.size_b)
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[np.cumsum(in_a) - 1] = last_b[np.cumsum(in_b) - 1] = True
        # A's tokens of a group stand before B's of the same group.
        before = np.concatenate([[0], np.cumsum(in_b)])
        code[np.arange(len(ids_a)) + before[group_a]] = ids_a + va * last_a
        after = np.cumsum(in_a)
        code[np.arange(len(ids_b)) + after[group_b]] = 2 * va + ids_b + vb * last_b
        words, ends = self.shown[code], np.cumsum(n_tokens)
        return ["".join(words[e - n:e].tolist())[:-1] for e, n in zip(ends.tolist(), n_tokens.tolist())]


_MADE: dict[tuple, Aligner] = {}


def _slices(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > SLICE:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if texts:
        yield slice(start, len(texts))


def _encode(files, printed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = files.value
        name = tuple(hashlib.sha256(x).digest() for x in raw)
        if name not in _MADE:
            _MADE.clear()
            _MADE[name] = Aligner(*raw)
        for batch in batches:
            texts = [t or "" for t in batch["__text"].to_pylist()]
            for part in _slices(texts):
                got = _MADE[name].align(texts[part])
                offsets = pa.array(got["pair_ends"], pa.int32())
                shown = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got["groups"]]
                yield pa.RecordBatch.from_arrays(
                    [batch["__own"][part.start:part.stop], batch["__row"][part.start:part.stop],
                     *(pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                     pa.array(got["groups"] if printed else [None] * len(shown), pa.string()), pa.array(shown, pa.string()),
                     *(pa.ListArray.from_arrays(offsets, pa.array(got[c], pa.int64())) for c in ("pairs", "links"))],
                    names=["__own", "__row", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "__pairs", "__links"])

    return run


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def align(docs: DataFrame, file_a: str, file_b: str, printed: bool = False) -> DataFrame:
    """The rows of ``docs`` with struct ``aligned`` for tokenizers A (byte-level BPE file) and B (piece model).

    Fields: n_a, n_b, n_groups, n_links, n_best (links whose pair is linked in as many documents as A's best
    pair, ties included), count_sum (documents of the pair, added up over links), groups_sha256, and with
    ``printed`` the text of the groups themselves (else null). ``docs`` has ``text``; its other columns stay whatever their
    names, but ``aligned`` is replaced. Special tokens in texts are plain text. Texts that are null or empty, or whose
    tokens don't give back space and text byte for byte, have zeros and ''. Each row counts as a document, repeated ones too.
    Empty input gives an empty result.

    Both files are read by the driver and sent to the tasks; their sizes don't grow with the corpus. Whole texts are
    encoded; a text and its tokens are held in memory, some 100 bytes a byte of text in the largest. Pairs are counted with
    partial sums. The at most ``HEAVY`` pairs that hold a HEAVY-th of all (document, pair) rows meet those rows by
    broadcast, so a pair in every document fills no task; the others meet by shuffle.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((_read(file_a), _read(file_b)))
    work = Workspace(spark, "alignment")
    keep = [c for c in docs.columns if c.lower() != "aligned"]
    given = docs.select(F.struct(*keep).alias("__own"), F.col("text").alias("__text"), F.monotonically_increasing_id().alias("__row"))
    own = given.schema["__own"].dataType.simpleString()
    encoded = work.save("encoded", given.mapInArrow(_encode(files, printed), (
        f"__own {own}, __row long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
        "__pairs array<long>, __links array<long>")))
    counts = work.save("counts", encoded.select(F.explode("__pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")))
    agreed = agreement(encoded, work.save("pairs", ranked_pairs(counts)))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = encoded.drop("__pairs", "__links").join(agreed, "__row", "left")
    return out.select("__own.*", F.struct("n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"),
                                          "groups_sha256", "groups").alias("aligned"))


def ranked_pairs(counts: DataFrame) -> DataFrame:
    """(pair, count, best): whether no pair of the same A id is linked in more documents."""
    first = F.shiftright("pair", B_BITS)
    most = counts.groupBy(first.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", first).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def agreement(encoded: DataFrame, counted: DataFrame) -> DataFrame:
    """(__row, n_best, count_sum) of documents with links."""
    total = counted.agg(F.sum("count")).first()[0] or 0
    heavy = counted["count"] * HEAVY >= total
    held = encoded.select("__row", F.explode(F.arrays_zip("__pairs", "__links")).alias("x")).select(
        "__row", F.col("x.__pairs").alias("pair"), F.col("x.__links").alias("links"))
    often = F.broadcast(counted.where(heavy))
    sums = (F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    parts = [held.join(often, "pair"), held.join(often, "pair", "left_anti").join(counted.where(~heavy), "pair")]
    return parts[0].groupBy("__row").agg(*sums).unionByName(parts[1].groupBy("__row").agg(*sums)).groupBy("__row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))

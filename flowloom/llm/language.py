"""Language identification by cross-parsing entropy (operator 5).

A suffix automaton of labelled text per language reads a document as the longest phrases that occur in
that text. Phrases times log2 of the text's length over the document's length estimates the cross
entropy; the language with the least wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowloom.llm import hashing as H

#: Labelled text per language: at most this many documents, and as many characters of them.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 16_000
SEGMENT = 512
_letters: list[np.ndarray] = []
_built: dict[Profile, tuple] = {}


class Profile(NamedTuple):
    """Languages in order and the labelled text of each."""

    languages: tuple[str, ...]
    texts: tuple[str, ...]


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def automaton(codes: list[int], size: int) -> np.ndarray:
    """Suffix automaton as a table of (next state * size) * 2, plus 1 if the code begins a new phrase.

    Reading starts in the last state, from which every code begins a phrase. A code that the text lacks
    is a phrase of its own and leads back there. The last code stands for padding and keeps the state.
    """
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    unit, fresh = 2 * size, len(step)
    begin = np.full(size, fresh * unit + 1)
    for c, to in step[0].items():
        begin[c] = to * unit + 1
    table = np.tile(begin, (fresh + 1, 1))
    for i, row in enumerate(step):
        if row:
            table[i, list(row)] = np.fromiter(row.values(), np.int64, len(row)) * unit
    table[:, size - 1] = np.arange(fresh + 1) * unit
    return table.astype(np.int32).ravel()


def _model(profile: Profile):
    """Codes of all characters and one table per language; kept for the life of the worker."""
    if profile not in _built:
        texts = [x.lower() for x in profile.texts]
        letters = sorted({c for x in texts for c in x if c.isalpha()})
        codes = np.where(_is_letter(), len(letters) + 1, 0).astype(np.int16)
        codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        size = len(letters) + 3
        tables = [automaton(_coded(x, codes)[0].tolist(), size) for x in texts]
        _built.clear()
        _built[profile] = codes, size, tables, np.array([np.log2(max(2, len(x))) for x in texts])
    return _built[profile]


def _coded(text: str, codes: np.ndarray) -> tuple[np.ndarray, bool]:
    """Codes of a text in lower case, runs of other characters than letters as one; whether it has a letter."""
    out = codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = out == 0
    keep = ~(gap & np.concatenate(([False], gap[:-1]))) if len(out) else gap
    return out[keep], not gap.all()


def identify(texts: list[str | None], profile: Profile) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, read in full in segments side by side."""
    if not profile.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    codes, size, tables, bits = _model(profile)
    coded = [_coded((x or "").lower(), codes) for x in texts]
    lengths = np.array([len(c) for c, _ in coded])
    pieces = -(-lengths // SEGMENT)
    grid = np.full(int(pieces.sum()) * SEGMENT, size - 1, np.int32)
    at = np.concatenate(([0], np.cumsum(pieces))) * SEGMENT
    for (c, _), start in zip(coded, at):
        grid[start:start + len(c)] = c
    grid = np.ascontiguousarray(grid.reshape(-1, SEGMENT).T)
    owner = np.repeat(np.arange(len(texts)), pieces)
    cost = np.empty((len(tables), len(texts)))
    for i, table in enumerate(tables):
        state, count = np.full(grid.shape[1], (len(table) - size) * 2, np.int32), np.zeros(grid.shape[1], np.int32)
        for column in grid:
            state = table[(state >> 1) + column]
            count += state & 1
        cost[i] = np.bincount(owner, count, len(texts)) * bits[i] / np.maximum(1, lengths)
    best = cost.argmin(0)
    names, score = [], np.zeros(len(texts))
    for j, (_, lettered) in enumerate(coded):
        names.append(profile.languages[best[j]] if lettered else "und")
        if lettered:
            rest = np.delete(cost[:, j], best[j])
            score[j] = 1.0 if not len(rest) else 1.0 - cost[best[j], j] / rest.min()
    return names, score


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Profile:
    """Labelled text per language from (doc_id, lang, text), a bounded sample in hash order, short texts first.

    Rows with a null lang, doc_id or text do not count. The result has at most ``chars`` characters a language.
    """
    order = W.partitionBy("lang").orderBy(F.length("text") > 4000, F.xxhash64("doc_id"), "doc_id", "text")
    drawn = (docs.where("lang is not null and doc_id is not null and text is not null").select("lang", "doc_id", "text")
             .withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
             .withColumn("before", F.sum(F.length("text")).over(W.partitionBy("lang").orderBy("n").rowsBetween(W.unboundedPreceding, -1)))
             .where(F.coalesce("before", F.lit(0)) < chars))
    found: dict[str, list[str]] = {}
    for row in drawn.orderBy("lang", "n").select("lang", "text").collect():
        found.setdefault(row["lang"], []).append(row["text"])
    names = tuple(sorted(found))
    return Profile(names, tuple(" ".join(found[x])[:chars] for x in names))


def predict(docs: DataFrame, profile: Profile) -> DataFrame:
    """``docs`` (column text) with lang_pred and score; given columns of these names are replaced.

    A null text or one without a letter gets ``und`` and score 0, as does every text if no language was
    learned. Ties go to the first language by name. The score is how far the best language's estimate lies under the
    second's, from 0 (equal) towards 1. An empty table gives an empty table.
    """
    docs = docs.drop("lang_pred", "score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in H.pack([x or "" for x in texts], 1 << 21):
                names, score = identify(texts[a:b], profile)
                own = batch.slice(a, b - a)
                yield pa.record_batch([*own.columns, pa.array(names, pa.string()), pa.array(score)],
                                      names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")

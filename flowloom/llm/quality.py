"""Quality classifier: Naive Bayes support vectors (operator 1).

Features are indicators of word n-grams and of n-grams of word shapes. Each is scaled by the log ratio
of its class counts; a linear hinge-loss model is fitted on the scaled rows by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import hashing as H

BUCKETS = 1 << 18
SAMPLE = 4000
#: Bytes of text whose features are held at once.
_CHUNK = 1 << 19
#: Class of each byte of a word's shape: letters and digits fold, all other bytes stay as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97


class Model(NamedTuple):
    """Log-count ratios, ratio times weight per bucket, and the bias."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float


def features(texts: list[str], buckets: int = BUCKETS) -> list[np.ndarray]:
    """Sorted feature buckets of each text; a text without words has none."""
    out: list[np.ndarray] = []
    raw = [x.encode() for x in texts]
    for a, b in H.pack(raw):
        words, offsets = H.word_hashes([x.lower().encode() for x in texts[a:b]], 11)
        marks, _ = H.word_hashes(_shapes(raw[a:b]), 12)
        again = np.concatenate(([False], words[1:] == words[:-1])) if len(words) else np.zeros(0, bool)
        if len(marks) != len(words):  # lower case can bring in or take away no ASCII white space, so this is a guard
            raise AssertionError("words and shapes differ in number")
        marks = H.mix(marks + again.astype(H.U))
        streams = [words, _pair(words, 1), marks, _pair(marks, 1), _pair(_pair(marks, 1), 1)]
        spread = [(H.mix(s + H.U(i)) % H.U(buckets)).astype(np.int32) for i, s in enumerate(streams)]
        for x, y in zip(offsets[:-1], offsets[1:]):
            own = np.concatenate([s[x:max(x, y - skip)] for s, skip in zip(spread, (0, 1, 0, 1, 2))])
            own.sort()
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
    return out


def _shapes(raw: list[bytes]) -> list[bytes]:
    out = []
    for x in raw:
        kind = _SHAPE[np.frombuffer(x, np.uint8)]
        if len(kind):
            kind = kind[np.concatenate(([True], kind[1:] != kind[:-1]))]
        out.append(kind.tobytes())
    return out


def _pair(x: np.ndarray, step: int) -> np.ndarray:
    return x[:-step] * H.U(0x9E3779B97F4A7C15) + x[step:] if len(x) > step else x[:0]


def fit(rows: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, smooth: float = 1.0, cost: float = 1.0,
        passes: int = 30, tolerance: float = 1e-3) -> Model:
    """Fit on feature rows and 0/1 labels. Without both classes every score is the share of label 1."""
    if not len(rows) or labels.min() == labels.max():
        share = float(np.mean(labels)) if len(rows) else 0.5
        share = min(max(share, 0.001), 0.999)
        zero = np.zeros(buckets, np.float32)
        return Model(zero, zero, float(np.log(share / (1 - share))) / SLOPE)
    counts = [np.zeros(buckets), np.zeros(buckets)]
    for row, y in zip(rows, labels):
        counts[int(y)][row] += 1
    total = [float((labels == y).sum()) for y in (0, 1)]
    rate = [(c + smooth) / (t + 2 * smooth) for c, t in zip(counts, total)]
    ratio = np.where(counts[0] + counts[1] > 0, np.log(rate[1] / rate[0]), 0.0).astype(np.float32)
    scaled = [_unit(ratio[row]) for row in rows]
    square = np.array([float(v @ v) + 1.0 for v in scaled])
    sign = np.where(labels > 0, 1.0, -1.0)
    dual, w, bias = np.zeros(len(rows)), np.zeros(buckets), 0.0
    draw = np.random.default_rng(7)
    for _ in range(passes):
        worst = 0.0
        for i in draw.permutation(len(rows)):
            row, x, y = rows[i], scaled[i], sign[i]
            slope = y * (float(w[row] @ x) + bias) - 1.0
            new = min(max(dual[i] - slope / square[i], 0.0), cost)
            move = new - dual[i]
            if move:
                dual[i] = new
                w[row] += move * y * x
                bias += move * y
                worst = max(worst, abs(move))
        if worst < tolerance:
            break
    return Model(ratio, (ratio * w).astype(np.float32), bias)


#: Margin to probability: a margin of 1 counts as about 0.98.
SLOPE = 4.0


def _unit(x: np.ndarray) -> np.ndarray:
    norm = float(np.sqrt(x @ x))
    return x / norm if norm else x


def score(rows: list[np.ndarray], model: Model) -> np.ndarray:
    out = np.empty(len(rows))
    for i, row in enumerate(rows):
        norm = float(np.sqrt(np.square(model.ratio[row]).sum()))
        out[i] = (float(model.weight[row].sum()) / norm if norm else 0.0) + model.bias
    return 1.0 / (1.0 + np.exp(-SLOPE * np.clip(out, -20, 20)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in H.pieces(batch, _CHUNK):
            rows = [x.tobytes() for x in features(part["text"].to_pylist())]
            yield pa.record_batch([part["label"], pa.array(rows, pa.binary())], names=["label", "features"])


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in H.pieces(batch, _CHUNK):
                value = score(features([x or "" for x in part["text"].to_pylist()]), model)
                yield pa.record_batch([*part.columns, pa.array(value)], names=[*part.schema.names, "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents, the first by a hash of their doc_id.

    ``labels`` holds doc_id and the 0/1 label. Documents with two different labels, null labels, null
    doc_ids and null texts are not learned from.
    """
    clear = (labels.where(f"doc_id is not null and {label} in (0, 1)").groupBy("doc_id")
             .agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other"))
    drawn = clear.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers: bounded, so it may be broadcast.
    learned = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("label", "text")
    rows = learned.mapInArrow(_rows, "label int, features binary").limit(2 * sample).collect()
    return fit([np.frombuffer(r["features"], np.int32) for r in rows], np.array([r["label"] for r in rows], int))


def held_out(mod: int = 5, value: int = 0):
    """Whether crc32 of the doc_id as text leaves ``value``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == value, F.lit(False))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1); given columns stay, a given ``score`` is replaced.

    Null and empty texts have no features and get the score of the bias alone. Repeated rows get the
    same score; an empty table gives an empty table.
    """
    docs = docs.drop("score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    return docs.mapInArrow(_scorer(model), f"{kinds}, score double")

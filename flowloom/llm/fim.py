"""Fill-in-the-middle documents cut through a wavelet matrix over character classes (operator 12).

The code points of many texts lie side by side in one wavelet matrix of their classes. How many units
(lines, sentences, words) begin or end before a place is a sum of rank queries; where the k-th unit ends is a
select on one class, found by bisection on the ranks, for both cuts of every text at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of one wavelet matrix; a longer text has one to itself.
SLICE = 1 << 20
OTHER, LETTER, DIGIT, SPACE, NEWLINE, STOP, MARK, WORD_START = range(8)
#: Characters that end a sentence.
SENTENCE_ENDS = ".!?…。！？"
#: The class whose characters close a unit, or open it; the last unit needs no closing character.
UNITS = {"line": ((NEWLINE,), "close"), "sentence": ((NEWLINE, STOP), "close"), "word": ((WORD_START,), "open")}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, from its Unicode category."""
    first = {"L": LETTER, "N": DIGIT, "Z": SPACE, "P": MARK, "S": MARK}
    table = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[[ord(c) for c in "\t\r\x0b\x0c"]] = SPACE
    table[ord("\n")] = NEWLINE
    table[[ord(c) for c in SENTENCE_ENDS]] = STOP
    return table


class WaveletMatrix:
    """Rank and select over a sequence of small codes, in one bit vector per binary digit, the highest first."""

    def __init__(self, codes: np.ndarray, digits: int = 3):
        self.size, self.digits, self.levels = len(codes), digits, []
        for digit in reversed(range(digits)):
            bits = (codes >> digit) & 1
            words = np.zeros(len(codes) // 64 + 1, np.uint64)
            packed = np.packbits(bits, bitorder="little")
            words.view(np.uint8)[:len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((words, before, self.size - int(before[-1])))
            codes = np.concatenate([codes[bits == 0], codes[bits == 1]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        cell = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[cell] + np.bitwise_count(words[cell] & mask)

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often ``code`` stands before each place of ``at``."""
        at, low = np.asarray(at, np.int64), np.zeros(1, np.int64)
        for (words, before, zeros), digit in zip(self.levels, reversed(range(self.digits))):
            ones, low_ones = self._ones(words, before, at), self._ones(words, before, low)
            at, low = (zeros + ones, zeros + low_ones) if code >> digit & 1 else (at - ones, low - low_ones)
        return at - low

    def count(self, codes: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """Boundary count: characters of any of ``codes`` before each place."""
        return sum(self.rank(code, at) for code in codes)

    def select(self, codes: tuple[int, ...], nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least place in ``low..high`` before which at least ``nth`` characters of ``codes`` stand, ``high`` if none."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.count(codes, middle) >= nth
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def cut(texts: list[str], draws: np.ndarray, unit: str = "line") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of units of each text, and the code points of its two cuts.

    ``draws`` has two whole numbers a text; modulo units + 1 they say after how many units the cuts are.
    """
    codes, kind = UNITS[unit]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - [len(t) for t in texts]
    classes = _classes()[points]
    if kind == "open":
        inside = (classes != SPACE) & (classes != NEWLINE)
        before = np.concatenate([[False], inside[:-1]])
        before[starts[starts < len(points)]] = False
        classes[inside & ~before] = WORD_START
    matrix = WaveletMatrix(classes)
    base = matrix.count(codes, starts)
    n = matrix.count(codes, ends) - base
    if kind == "close":
        # What follows the last closing character is a unit too.
        n = n + ((ends > starts) & (matrix.count(codes, np.maximum(ends - 1, starts)) - base == n))
    cuts = np.sort(draws % (n + 1)[:, None], axis=1)
    places = []
    for k in cuts.T:
        if kind == "close":
            at = matrix.select(codes, base + k, starts, ends)
        else:  # a unit ends where the next one opens; white space before the first one belongs to it
            at = np.where(k == 0, starts, matrix.select(codes, base + k + 1, starts, ends) - (k < n))
        places.append(at - starts)
    return n, places[0], places[1]


def arrange(text: str, form: str, first: int, second: int) -> str:
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else text


def restore(output: str, form: str) -> str:
    """The text an output was made of. The parts hold no marker, and no marker arises where two of them meet."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    left, _, right = head.partition(SUFFIX if form == "psm" else PREFIX)
    prefix, suffix = (left[len(PREFIX):], right) if form == "psm" else (right, left[len(SUFFIX):])
    return prefix + middle + suffix


def _slices(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > SLICE:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    yield slice(start, len(texts))


def _transform(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["__text"].to_pylist()
            draws = np.stack([batch[c].to_numpy() for c in ("__h1", "__h2")], axis=1)
            forms = batch["__form"].to_pylist()
            for part in _slices(texts):
                own, kinds = texts[part], forms[part]
                n, first, second = cut(own, draws[part], unit)
                outputs = [arrange(*x) for x in zip(own, kinds, first.tolist(), second.tolist())]
                plain = pa.array([k == "plain" for k in kinds])
                null = pa.scalar(None, pa.int64())
                lengths = [pa.compute.if_else(plain, null, pa.array(x)) for x in (first, second - first)]
                yield pa.RecordBatch.from_arrays(
                    [batch["__own"][part.start:part.stop], pa.array(n), pa.array(kinds, pa.string()), *lengths,
                     pa.array(outputs, pa.string()), pa.array([restore(*x) for x in zip(outputs, kinds)], pa.string())],
                    names=["__own", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    return run


def _draw(seed: int, group: int) -> Column:
    """One of the first 8-digit groups of sha256("seed:doc_id") as a whole number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line") -> DataFrame:
    """The rows of ``docs`` with struct ``fim``: n, form, prefix_chars, middle_chars, output, restored.

    ``docs`` has doc_id and text; other columns stay, whatever their names, but a column ``fim`` is replaced. A
    text is cut twice between units: ``line`` (up to and with a line end), ``sentence`` (up to and with a
    sentence or line end) or ``word`` (a run of non-space with the space after it). Cuts and form come from
    sha256 of the seed and doc_id, so rows with one doc_id are cut by the same draws and reruns agree; a null doc_id
    counts as empty. ``rate`` of 100 documents are rearranged, ``spm`` of 100 of these with the suffix first.
    Null texts count as empty; empty texts and texts that hold a marker stay plain with null lengths. Whole texts
    are cut, however long; one text is held about ten times in memory. Empty input gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    held = [F.contains(text, F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (text == "") | held[0] | held[1] | held[2] | (_draw(seed, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(seed, 3) % 100 < spm, "spm").otherwise("psm")
    keep = [c for c in docs.columns if c.lower() != "fim"]
    given = docs.select(F.struct(*keep).alias("__own"), text.alias("__text"), _draw(seed, 0).alias("__h1"),
                        _draw(seed, 1).alias("__h2"), form.alias("__form"))
    own = given.schema["__own"].dataType.simpleString()
    out = given.mapInArrow(_transform(unit), f"__own {own}, n long, form string, prefix_chars long, middle_chars long, "
                                             "output string, restored string")
    fields = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")
    return out.select("__own.*", F.struct(*fields).alias("fim"))

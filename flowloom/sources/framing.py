"""Frames of capture files read by byte ranges.

A capture has no index and its records have no marks, so a reader that starts in the middle must find a record
start. Stepping from one record to the next is a function of the position alone: behind a sound header lies the next
one, and behind a damaged header the place with the longest chain of strict headers. Two readers that meet at one
position therefore agree from there on. A reader starts before its range, at a chain longer than any record: one
that began inside a packet, say in a capture sent over the network, breaks where that packet ends. If there is no such chain the
reader starts earlier, in the end at the file's first record. A record belongs to the range it starts in.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np

#: Fixed values of both formats.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", False), b"\xa1\xb2\xc3\xd4": (">", False),
           b"\x4d\x3c\xb2\xa1": ("<", True), b"\xa1\xb2\x3c\x4d": (">", True)}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
#: No record is taken to be longer than this unless the file header says so.
LONGEST = 262_144
#: Headers in a row from which reading goes on behind a damaged place.
CHAIN = 2
CHUNK = 4 << 20


class Frame(NamedTuple):
    """One captured frame, or with ``issue`` a place where the file cannot be read."""

    offset: int
    ts_us: int
    link: int
    data: bytes
    issue: str | None = None


class Link(NamedTuple):
    """What an interface block says: where it stands, its link type and its clock ticks a second."""

    offset: int
    link: int
    ticks: int


class Window:
    """Random reads from a file through one buffer."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size, self.start, self.held = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``, fewer at the end of the file."""
        n = max(0, min(n, self.size - at))
        if at < self.start or at + n > self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(min(max(n, CHUNK), self.size - at))
        return self.held[at - self.start:at - self.start + n]


def _numbers(data: bytes, order: str) -> np.ndarray:
    """The 32-bit number at every byte of ``data``, as 64-bit numbers."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    if len(b) < 4:
        return np.zeros(0, np.int64)
    parts = [b[i:len(b) - 3 + i] for i in range(4)]
    return sum(p << 8 * (i if order == "<" else 3 - i) for i, p in enumerate(parts))


class ClassicFile:
    """A file of fixed header and records."""

    first, margin = 24, 16

    def __init__(self, window: Window, magic: bytes):
        self.window = window
        self.order, self.nano = CLASSIC[magic]
        snap, link = struct.unpack(self.order + "II", window.read(16, 8))
        self.link, self.longest = link & 0x0FFFFFFF, max(snap if snap < 1 << 28 else 0, LONGEST)

    def _head(self, at: int) -> tuple[int, int, int, int] | None:
        head = self.window.read(at, 16)
        return struct.unpack(self.order + "IIII", head) if len(head) == 16 else None

    def sound(self, at: int) -> int | None:
        """Where the record at ``at`` ends, ``None`` if its length can't be true."""
        head = self._head(at)
        if head is None or head[2] > self.longest or at + 16 + head[2] > self.window.size:
            return None
        return at + 16 + head[2]

    def strict(self, at: int) -> int | None:
        head, end = self._head(at), self.sound(at)
        fits = head is not None and head[2] <= head[3] <= max(self.longest, head[2]) and 0 < head[2] and head[1] < (10 ** 9 if self.nano else 10 ** 6)
        return end if fits else None

    def candidates(self, start: int, stop: int) -> Iterator[int]:
        """Places from ``start`` to before ``stop`` that might be headers, in order."""
        for low in range(start, stop, LONGEST):
            high = min(low + LONGEST, stop)
            fields = _numbers(self.window.read(low, high - low + 15), self.order)
            n = max(0, len(fields) - 12)
            frac, kept, full = fields[4:4 + n], fields[8:8 + n], fields[12:12 + n]
            good = (frac < (10 ** 9 if self.nano else 10 ** 6)) & (kept > 0) & (kept <= self.longest) & (full >= kept)
            yield from (np.flatnonzero(good[:high - low]) + low).tolist()

    def frame(self, at: int, end: int) -> Frame | None:
        sec, frac, size, _ = self._head(at)
        return Frame(at, sec * 1_000_000 + (frac // 1000 if self.nano else frac), self.link, self.window.read(at + 16, size))


class BlockFile:
    """A file of typed blocks, each with its length at both ends."""

    first, margin = 0, 12

    def __init__(self, window: Window, late: list[Link]):
        self.window, self.late, self.longest = window, sorted(late), LONGEST + 4096
        self.order, self.links = "<", []
        at = 0
        # Sections and interfaces up to the first packet are read here; later ones come in ``late`` or on the way.
        while (end := self.sound(at)) is not None and self._kind(at) not in (SIMPLE, ENHANCED):
            self.note(at, end)
            at = end
        self.head, self.base = at, (self.order, self.links)

    def _kind(self, at: int) -> int:
        raw = self.window.read(at, 4)
        return struct.unpack(self.order + "I", raw)[0] if len(raw) == 4 else -1

    def _order_at(self, at: int) -> str:
        head = self.window.read(at, 12)
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            return "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        return self.order

    def sound(self, at: int) -> int | None:
        order = self._order_at(at)
        head = self.window.read(at, 8)
        if len(head) < 8:
            return None
        size = struct.unpack(order + "I", head[4:])[0]
        if size % 4 or not 12 <= size <= max(self.longest, 1 << 24) or at + size > self.window.size:
            return None
        return at + size if self.window.read(at + size - 4, 4) == head[4:] else None

    strict = sound

    def candidates(self, start: int, stop: int) -> Iterator[int]:
        start += -start % 4
        for low in range(start, stop, LONGEST):
            high = min(low + LONGEST, stop)
            size = _numbers(self.window.read(low, high - low + 8), self.order)[4:]
            good = np.flatnonzero(((size >= 12) & (size % 4 == 0) & (size <= 1 << 24))[:high - low])
            yield from (good[good % 4 == 0] + low).tolist()

    def note(self, at: int, end: int) -> None:
        """Take in a section or interface block."""
        self.order = self._order_at(at)
        kind = self._kind(at)
        if kind == SECTION:
            self.links = []
        elif kind == INTERFACE and end - at >= 20:
            self.links.append(interface(self.window.read(at, end - at), at, self.order))

    def enter(self, at: int) -> None:
        """Be in the section of ``at``: the head of the file and what ``late`` says of blocks before that place."""
        self.order, self.links = self.base[0], list(self.base[1])
        for link in self.late:
            if link.offset >= at:
                break
            if link.link < 0:  # a section, its byte order in place of ticks
                self.order, self.links = "<" if link.ticks else ">", []
            else:
                self.links.append(link)

    def frame(self, at: int, end: int) -> Frame | None:
        kind, body = self._kind(at), None
        if kind in (SECTION, INTERFACE):
            self.note(at, end)
            return None
        if kind == ENHANCED and end - at >= 32:
            body = self.window.read(at + 8, end - at - 12)
            face, high, low, kept, _ = struct.unpack_from(self.order + "IIIII", body, 0)
            if face >= len(self.links) or 20 + kept > len(body):
                return Frame(at, 0, -1, b"", "unknown_interface" if face >= len(self.links) else "truncated")
            own = self.links[face]
            return Frame(at, ((high << 32) | low) * 1_000_000 // own.ticks, own.link, body[20:20 + kept])
        if kind == SIMPLE and end - at >= 16 and self.links:
            body = self.window.read(at + 8, end - at - 12)
            return Frame(at, 0, self.links[0].link, body[4:4 + struct.unpack_from(self.order + "I", body, 0)[0]])
        return None


def interface(block: bytes, at: int, order: str) -> Link:
    """Link type and clock of an interface block; ticks are option 9, one million a second without it."""
    options, place = block[16:-4], 0
    ticks = 1_000_000
    while place + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, place)
        if code == 0:
            break
        if code == 9 and size >= 1:
            value = options[place + 4]
            ticks = 2 ** (value & 0x7F) if value & 0x80 else 10 ** value
            break
        place += 4 + (size + 3) // 4 * 4
    return Link(at, struct.unpack_from(order + "H", block, 8)[0], ticks)


def open_capture(file: BinaryIO, size: int, late: list[Link] | None = None) -> ClassicFile | BlockFile | None:
    """Reader of a capture, ``None`` for any other file."""
    window = Window(file, size)
    magic = window.read(0, 4)
    if magic in CLASSIC and size >= 24:
        return ClassicFile(window, magic)
    return BlockFile(window, late or []) if magic == b"\x0a\x0d\x0d\x0a" else None


def _best_chain(capture: ClassicFile | BlockFile, start: int, stop: int, limit: int) -> tuple[int, int, int] | None:
    """(place, headers, end) of the longest chain of strict headers that begins from ``start`` to before ``stop``.

    Chains are followed up to ``limit`` or the end of the file. They run together, so each place is stepped over once.
    """
    ends: dict[int, tuple[int, int]] = {}
    best = None
    for place in capture.candidates(start, stop):
        path, at = [], place
        while at not in ends:
            after = capture.strict(at) if at < min(limit, capture.window.size) else None
            if after is None:
                ends[at] = (0, at)
            else:
                path.append(at)
                at = after
        for step in reversed(path):
            ends[step] = (ends[at][0] + 1, ends[at][1])
            at = step
        headers, end = ends[place]
        if headers and (best is None or end - place > best[2] - best[0]):
            best = (place, headers, end)
    return best


def resync(capture: ClassicFile | BlockFile, start: int) -> int | None:
    """Where reading goes on behind a damaged place: the longest chain that begins within one record's length, or in the next such stretch."""
    span, size = capture.longest + capture.margin, capture.window.size
    for low in range(start, size, span):
        found = _best_chain(capture, low, min(low + span, size), low + 3 * span)
        if found is not None and (found[1] >= CHAIN or found[2] == size):
            return found[0]
    return None


def first_record(capture: ClassicFile | BlockFile, start: int) -> int:
    """Where to begin walking so as to be at a true record when reaching ``start``."""
    span = capture.longest + capture.margin
    back = span
    while start - back > capture.first:
        found = _best_chain(capture, start - back, start, start + 2 * span)
        if found is not None and found[2] - found[0] > span:
            return found[0]
        back *= 4
    return capture.first


def walk(capture: ClassicFile | BlockFile, start: int, stop: int) -> Iterator[tuple[int, int | None]]:
    """(start, end) of the records and blocks that start in the range; end ``None`` for a damaged place.

    Bytes too few for a header at the end of the file are a damaged place as well.
    """
    at = capture.first
    if start > capture.first:
        if isinstance(capture, BlockFile):
            capture.enter(start)  # the byte order to look for
        at = first_record(capture, start)
        if isinstance(capture, BlockFile):
            capture.enter(at)
    size = capture.window.size
    while at < min(stop, size):
        end = capture.sound(at)
        if at >= start:
            yield at, end
        elif end is not None and isinstance(capture, BlockFile):
            capture.note(at, end)
        if end is None:
            end = resync(capture, at + 1)
            if end is None:
                return
        at = end


def frames(capture: ClassicFile | BlockFile, start: int, stop: int) -> Iterator[Frame]:
    """Frames and issues that start in the range."""
    for at, end in walk(capture, start, stop):
        found = Frame(at, 0, -1, b"", "truncated") if end is None else capture.frame(at, end)
        if found is not None:
            yield found


def late_links(capture: ClassicFile | BlockFile, start: int, stop: int) -> Iterator[Link]:
    """Sections (link -1, ticks 1 for little-endian) and interfaces in the range that stand behind the file's first packet."""
    if isinstance(capture, BlockFile):
        for at, end in walk(capture, max(start, capture.head), stop):
            kind = capture._kind(at) if end is not None else None
            if kind == SECTION:
                capture.note(at, end)
                yield Link(at, -1, int(capture.order == "<"))
            elif kind == INTERFACE and end - at >= 20:
                yield interface(capture.window.read(at, end - at), at, capture.order)

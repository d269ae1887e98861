"""Splitting texts into the pieces that byte-level BPE encodes one by one.

The rule is the published one of byte-level vocabularies: contractions, runs of
letters, of digits or of other signs with an optional leading space, and white
space. It is evaluated for all characters of a batch at once: every character
gets a class, and a piece begins where the class changes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from tidewatch.llm.arrays import expand, text_bytes

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
# The endings that a lone apostrophe takes with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_SKIP = 0x110000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(_SKIP, OTHER, np.uint8)
    letters = "".join(map(chr, [*range(0xD800), *range(0xE000, _SKIP)]))
    for kind, name in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, letters):
            table[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = kind
    return table


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces begin; rows are split apart."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _classes()[chars]
    n = len(chars)
    rows = np.zeros(n + 1, bool)
    rows[np.searchsorted(lead, starts[starts < len(data)])] = True
    rows[n] = True
    begin = np.ones(n + 1, bool)
    begin[1:n] = kind[1:] != kind[:-1]
    begin |= rows
    space = kind == SPACE
    # The last white space before a word is a piece of its own, or the word's lead if it is a blank.
    last = np.flatnonzero(space & begin[1:] & ~rows[1:])
    begin[last] = True
    blank = last[chars[last] == 32]
    begin[blank + 1] = False
    _split_contractions(chars, kind, begin, rows)
    return lead[np.flatnonzero(begin[:n])]


def _split_contractions(chars: np.ndarray, kind: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> None:
    """An apostrophe that stands alone takes a known ending from the letters after it."""
    n = len(chars)
    marks = np.flatnonzero((chars[:-1] == 39) & begin[: n - 1] & begin[1:n] & ~rows[1:n] & (kind[1:] == LETTER))
    for k in marks.tolist():
        for ending in CONTRACTIONS:
            stop = k + 1 + len(ending)
            if stop <= n and all(chars[k + 1 + i] == ord(c) for i, c in enumerate(ending)) and not begin[k + 2 : stop].any():
                begin[k + 1] = False
                begin[stop] = True
                break


class Encoder:
    """Ids of whole texts, from a function that encodes lists of distinct pieces to ids and counts.

    ``special`` maps strings that are tokens wherever they stand to their ids.
    Pieces seen before are remembered up to ``memory`` of them.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], special: dict[str, int], memory: int = 300_000):
        self.encode, self.special, self.memory = encode, special, memory
        self.known: dict[bytes, int] = {}
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.mark = regex.compile("|".join(map(regex.escape, special))) if special else None

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column and the number of ids of each row; null is empty."""
        data, starts = text_bytes(column)
        cuts, marked = self._special_cuts(data, starts)
        begin = piece_starts(data, cuts)
        distinct, codes = self._distinct(data, begin)
        first, count, flat = self._lookup(distinct)
        if len(marked):
            at = np.searchsorted(begin, marked[:, 0])
            codes = codes.copy()
            keep = np.ones(len(begin), bool)
            for (lo, hi, token), k in zip(marked.tolist(), at.tolist(), strict=True):
                codes[k] = len(first) + list(self.special.values()).index(token)
                keep[k + 1 : np.searchsorted(begin, hi)] = False
            begin, codes = begin[keep], codes[keep]
            first = np.append(first, len(flat) + np.arange(len(self.special)))
            count = np.append(count, np.ones(len(self.special), np.int64))
            flat = np.append(flat, np.array(list(self.special.values()), np.uint32))
        each = count[codes]
        ids = flat[expand(first[codes], each)]
        ends = np.concatenate(([0], np.cumsum(each)))
        bounds = ends[np.searchsorted(begin, starts)]
        return ids, np.diff(bounds)

    def _special_cuts(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.mark is None:
            return starts, np.zeros((0, 3), np.int64)
        raw = data.tobytes()
        if not any(s.encode() in raw for s in self.special):
            return starts, np.zeros((0, 3), np.int64)
        found = []
        for k in range(len(starts) - 1):
            text = raw[starts[k] : starts[k + 1]].decode("utf-8")
            for m in self.mark.finditer(text):
                lo = int(starts[k]) + len(text[: m.start()].encode())
                found.append((lo, lo + len(m[0].encode()), self.special[m[0]]))
        marked = np.array(found, np.int64).reshape(-1, 3)
        return np.unique(np.concatenate([starts, marked[:, 0], marked[:, 1]])), marked

    def _distinct(self, data: np.ndarray, begin: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        if len(begin) == 0:
            return [], np.zeros(0, np.int64)
        offsets = np.append(begin, len(data)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def _lookup(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each distinct piece begin, how many there are, and the ids."""
        place = np.fromiter((self.known.get(w, -1) for w in distinct), np.int64, len(distinct))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            words = [distinct[k] for k in fresh.tolist()]
            more, sizes = self.encode(words)
            more = more.astype(np.uint32)
            begins = len(self.flat) + np.cumsum(sizes) - sizes
            room = self.memory - len(self.known)
            first, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            old = place >= 0
            first[old], count[old] = self.begin[place[old]], self.size[place[old]]
            first[fresh], count[fresh] = begins, sizes
            flat = np.concatenate([self.flat, more])
            if room > 0:
                kept = min(room, len(words))
                base = len(self.known)
                self.known.update(zip(words[:kept], range(base, base + kept), strict=True))
                self.begin = np.append(self.begin, begins[:kept])
                self.size = np.append(self.size, sizes[:kept])
                self.flat = flat[: len(self.flat) + int(sizes[:kept].sum())]
            return first, count, flat
        return self.begin[place], self.size[place], self.flat


def sha256_rows(data: np.ndarray, counts: np.ndarray) -> list[str]:
    """Hex digests of consecutive slices of an array."""
    view, width = memoryview(np.ascontiguousarray(data)).cast("B"), data.itemsize
    ends = (np.cumsum(counts) * width).tolist()
    starts = [0, *ends[:-1]]
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(starts, ends, strict=True)]


def crc32_rows(data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of consecutive slices of an array."""
    view, width = memoryview(np.ascontiguousarray(data)).cast("B"), data.itemsize
    ends = (np.cumsum(counts) * width).tolist()
    starts = [0, *ends[:-1]]
    return np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(starts, ends, strict=True)), np.int64, len(counts))

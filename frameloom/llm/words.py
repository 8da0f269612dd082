"""Hashes of words and of runs of words, for chunks of texts at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time.
_CHUNK = 1 << 20
BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as needed."""

    def __init__(self, base: np.uint64):
        self._base, self._inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.zeros(0, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(self._base, n), _powers(self._inverse, n)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hashes of [start, end), whatever their place."""
    return (prefix[end] - prefix[start]) * powers.down[start]


class WordHasher:
    """Hashes of the words of chunks of texts."""

    def __init__(self):
        self._bytes = Powers(BASE)

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and for each text how many words end by its end.

        ``places`` then has the words' starts and ends in ``data``.
        """
        if len(ends) > 1 or len(data) <= 2 * _CHUNK:
            return self._words_of(data, ends)
        found, places, at = [], [], 0  # one long text: by blocks that end at white space
        while at < len(data):
            to = at + _CHUNK
            while to < len(data) and not _SPACE[data[to]]:
                gap = np.flatnonzero(_SPACE[data[to : to + 4096]])
                to += int(gap[0]) if len(gap) else 4096
            to = min(to, len(data))
            found.append(self._words_of(data[at:to], np.asarray([to - at]))[0])
            places.append([p + at for p in self.places])
            at = to
        self.places = tuple(np.concatenate(p) for p in zip(*places))
        hashes = np.concatenate(found)
        return hashes, np.asarray([len(hashes)])

    def _words_of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            self.places = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
        self._bytes.reach(n + 1)
        solid = ~_SPACE[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        heads = np.concatenate([[0], ends[:-1]])
        heads = heads[heads < n]
        first[heads] = solid[heads]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        tails = ends[(ends > 0)] - 1
        last[tails] = solid[tails]
        start, stop = self.places = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._bytes.up[:n], out=sums[1:])
        hashes = mix(ranges(sums, start, stop, self._bytes) + (stop - start).astype(np.uint64))
        return hashes, np.searchsorted(start, ends, side="left")


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _CHUNK, side="right")) - 1)
        yield at, to
        at = to


def text_chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and ends of the texts, some at a time; null texts are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    for a, b in _chunks(np.diff(offsets)):
        yield data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]

"""Statistics of whole texts, for chunks of texts at a time with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import WordHasher, text_chunks

_KINDS = [
    ("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("blank", b" "), ("line", b"\n"),
    ("other_blank", b"\t\r\x0b\x0c"), ("stop", b"."), ("comma", b","), ("colon", b":;"), ("shout", b"!"), ("ask", b"?"), ("pipe", b"|"),
    ("money", b"$"), ("percent", b"%"), ("and", b"&"), ("star", b"*"), ("hash", b"#"), ("at", b"@"), ("quote", b"\"'`"), ("dash", b"-_/\\"),
    ("bracket", b"()[]{}"), ("angle", b"<>"), ("sum", b"=+~^"), ("lead", bytes(range(192, 256))), ("tail", bytes(range(128, 192))),
]
_KIND = np.full(256, len(_KINDS), dtype=np.int64)
for _i, (_, _chars) in enumerate(_KINDS):
    _KIND[list(_chars)] = _i
_N = len(_KINDS) + 1
_AT = {name: i for i, (name, _) in enumerate(_KINDS)}

NAMES = [f"share_{name}" for name, _ in _KINDS] + [
    "share_other", "log_bytes", "log_words", "word_bytes", "word_spread", "longest_word", "short_words", "long_words", "upper_start", "all_upper",
    "mark_end", "distinct_words", "distinct_pairs", "commonest_word", "line_bytes", "repeated_lines", "stops_per_word", "odd_per_word", "symbol_words",
]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[128:] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and how often its commonest occurs."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]))
    times = np.diff(np.concatenate([head, [len(d)]]))
    most = np.zeros(n)
    np.maximum.at(most, d[head], times)
    return np.bincount(d[head], minlength=n).astype(float), most


def _of_chunk(hasher: WordHasher, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(ends)
    sizes = np.diff(ends, prepend=0)
    doc_of = np.repeat(np.arange(n), sizes)
    counts = np.bincount(doc_of * _N + _KIND[data], minlength=n * _N).reshape(n, _N).astype(float)
    total = np.maximum(sizes, 1)[:, None]
    words, upto = hasher.words(data, ends)
    per = np.diff(upto, prepend=0)
    own = np.repeat(np.arange(n), per)
    start, stop = hasher.places
    length = stop - start
    many = np.maximum(per, 1)
    mean = np.bincount(own, length, n) / many
    spread = np.sqrt(np.maximum(0, np.bincount(own, length.astype(float) ** 2, n) / many - mean**2))
    longest = np.zeros(n)
    np.maximum.at(longest, own, length)
    sums = [np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _LOWER, _MARK)]
    ups, lows, marks = (s[stop] - s[start] for s in sums)
    share = lambda mask: np.bincount(own, mask, n) / many
    kinds, most = _distinct(own, words, n)
    pair = own[1:] == own[:-1]
    pairs, _ = _distinct(own[1:][pair], (words[1:] * np.uint64(3) + words[:-1])[pair], n)
    lines = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([np.concatenate([[0], ends[:-1]])[sizes > 0], (lines + 1)[~np.isin(lines + 1, ends)]])).astype(np.int64)
    line_doc = np.searchsorted(ends, line_start, side="right")
    hashed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words, dtype=np.uint64)])
    first = np.searchsorted(start, line_start)
    line_end = np.concatenate([line_start[1:], [len(data)]])
    value = hashed[np.searchsorted(start, line_end)] - hashed[first]
    full = value != 0
    line_n = np.maximum(np.bincount(line_doc[full], minlength=n), 1)
    line_kinds, _ = _distinct(line_doc[full], value[full], n)
    odd = counts[:, [_AT[k] for k in ("shout", "pipe", "money", "percent", "and", "star", "hash", "at", "angle", "sum")]].sum(axis=1)
    columns = [
        counts / total,
        np.stack(
            [
                np.log1p(sizes), np.log1p(per), mean, spread, np.log1p(longest), share(length <= 3), share(length >= 12), share(_UPPER[data[start]]), share((ups >= 2) & (lows == 0)),
                share(_MARK[data[stop - 1]]), kinds / many, pairs / np.maximum(per - 1, 1), most / many, np.log1p(sizes / line_n), 1 - line_kinds / line_n, counts[:, _AT["stop"]] / many, odd / many,
                share(marks >= 2),
            ],
            axis=1,
        ),
    ]
    return np.concatenate(columns, axis=1).astype(np.float32)


class Statistics:
    """The features of ``NAMES`` for the texts of Arrow batches."""

    def __init__(self):
        self._hasher = WordHasher()

    def of(self, texts: pa.Array) -> np.ndarray:
        """Null and empty texts give zeros."""
        parts = [_of_chunk(self._hasher, data, ends) for data, ends in text_chunks(texts)]
        return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)), np.float32)

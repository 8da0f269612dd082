"""Exact byte-level BPE encoding, one library call for each distinct piece.

The byte-level pattern never lets a token span a single space that stands
between two non-space characters: that space always opens a new pre-token.  So
a text may be cut there, and the ids of the cuts, concatenated, are the ids of
the text.  Natural text repeats its words, which makes a small cache of pieces
far cheaper than encoding every text from scratch.  A piece of letters alone is
one pre-token, so it goes straight to the library's model, in the byte-level
alphabet.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import kept

_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")

#: Pieces in one generation of a worker's cache (there are two), and the longest
#: piece that is kept: about 200 MB for a worker at most.
CACHE_PIECES = 400_000
CACHE_PIECE_CHARS = 48
#: Marks that may end a piece and always make a pre-token of their own after a
#: letter.  The apostrophe isn't one: it starts contractions.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below this code point are letters in every version of Unicode.
_OLD_LETTERS = "\u0250"


class _Unsafe(Exception):
    """A piece starts or ends with white space, so plain cuts don't hold."""


class _Cache(dict):
    """Ids of pieces, each after ``before``: a space or nothing.  What a full
    generation holds is looked up once more before it goes."""

    def __init__(self, before: str, limit: int, encode, encode_letters):
        super().__init__()
        self._before, self._limit, self._encode, self._letters = before, limit, encode, encode_letters
        self._old: dict[str, bytes] = {}
        self._tails: dict[str, bytes] = {}
        self.bare = self
        self._line = encode("\n")

    def __missing__(self, piece: str) -> bytes:
        ids = self._old.get(piece)
        if ids is None:
            if piece.isalpha() and (piece.isascii() or max(piece) < _OLD_LETTERS):
                ids = self._letters(self._before, piece)
            elif not piece or piece[0].isspace() or piece[-1].isspace():
                raise _Unsafe
            else:
                ids = self._mixed(piece)
        if len(piece) <= CACHE_PIECE_CHARS:
            if len(self) >= self._limit:
                self._old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def _mixed(self, piece: str) -> bytes:
        if "\n" in piece:
            # A line end between two others is a pre-token of its own.
            first, *rest = piece.split("\n")
            try:
                return self[first] + b"".join([self._line + self.bare[x] for x in rest])
            except _Unsafe:
                return self._encode(self._before + piece)
        core = piece.rstrip(_MARKS)
        if len(core) < len(piece) and core.isalpha() and max(core) < _OLD_LETTERS:
            return self[core] + self._tail(piece[len(core) :])
        return self._encode(self._before + piece)

    def _tail(self, marks: str) -> bytes:
        ids = self._tails.get(marks)
        if ids is None:
            ids = self._encode(marks)
            if len(marks) <= 4 and len(self._tails) < 10_000:
                self._tails[marks] = ids
        return ids


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves, and the others, in
    order, as the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    """Encodes texts to packed little-endian ids of ``dtype``."""

    def __init__(self, path: str, dtype: np.dtype):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        alphabet = _byte_alphabet()
        self._space = alphabet[32]
        self._table = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(128, ord(_OLD_LETTERS))}
        letters = self._letters(self._tokenizer.model)
        self._cache, self._bare = (_Cache(before, limit, self._direct, letters) for before, limit in ((" ", CACHE_PIECES), ("", CACHE_PIECES // 8)))
        self._cache.bare = self._bare

    def _direct(self, text: str) -> bytes:
        return array(self._code, self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, model):
        space = self._space

        def encode(before: str, word: str) -> bytes:
            if not word.isascii():
                word = word.translate(self._table)
            return array(self._code, [t.id for t in model.tokenize(space + word if before else word)]).tobytes()

        return encode

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self._bare[first] + b"".join(map(self._cache.__getitem__, rest))
            except _Unsafe:
                pass
        head, *tail = _SAFE_CUT.split(text)
        return self._direct(head) + b"".join(self._piece(x) for x in tail)

    def _piece(self, piece: str) -> bytes:
        try:
            return self._cache[piece]
        except _Unsafe:  # only the text's last piece can end with white space
            return self._direct(" " + piece)


def id_dtype(path: str) -> np.dtype:
    """The narrowest unsigned type that holds every id of the vocabulary."""
    from tokenizers import Tokenizer

    return np.dtype("<u2") if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")


def worker_bpe(path: str, dtype: str) -> ByteBpe:
    """The encoder of this Python worker, kept between tasks."""
    return kept((ByteBpe, path, dtype), lambda: ByteBpe(path, np.dtype(dtype)))

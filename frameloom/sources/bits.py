"""Bit-level readers and writers, and the switch code of entropy coders."""

from __future__ import annotations

import numpy as np


def unpack(data: bytes, bits: int, count: int, *, little_words: bool = False) -> np.ndarray:
    """``count`` unsigned values of ``bits`` bits each, most significant first.

    ``little_words``: the bytes are 32-bit little-endian words.  What the data
    doesn't hold is 0.  Runs in pieces, so that memory stays near the result's.
    """
    raw = np.frombuffer(data, np.uint8)
    if little_words:
        whole = len(raw) // 4 * 4
        raw = np.concatenate([raw[:whole].reshape(-1, 4)[:, ::-1].ravel(), raw[whole:]])
    need = (count * bits + 7) // 8
    if len(raw) < need:
        have = len(raw) * 8 // bits
        return np.concatenate([unpack(raw.tobytes(), bits, have), np.zeros(count - have, np.uint16)])
    out, weights = np.empty(count, np.uint16), (1 << np.arange(bits - 1, -1, -1)).astype(np.uint32)
    step = 8 << 14  # values; a whole number of bytes
    for at in range(0, count, step):
        n = min(step, count - at)
        piece = np.unpackbits(raw[at * bits // 8 : (at * bits + n * bits + 7) // 8], count=n * bits)
        out[at : at + n] = piece.reshape(n, bits) @ weights
    return out


def pack(values: np.ndarray, bits: int, *, little_words: bool = False) -> bytes:
    v = np.asarray(values, np.uint32)
    raw = np.packbits(((v[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).ravel())
    if little_words:
        raw = np.concatenate([raw, np.zeros(-len(raw) % 4, np.uint8)]).reshape(-1, 4)[:, ::-1].ravel()
    return raw.tobytes()


class BitWriter:
    def __init__(self):
        self._value, self._n = 0, 0

    def put(self, bits: int, value: int) -> None:
        self._value = self._value << bits | (value & (1 << bits) - 1)
        self._n += bits

    def done(self) -> bytes:
        pad = -self._n % 8
        return (self._value << pad).to_bytes((self._n + pad) // 8, "big")


class BitReader:
    """Most significant bit first; zeros after the end."""

    def __init__(self, data: bytes):
        self._value, self._left = int.from_bytes(data, "big"), len(data) * 8

    def get(self, bits: int) -> int:
        self._left -= bits
        if self._left >= 0:
            return self._value >> self._left & (1 << bits) - 1
        return self._value << -self._left & (1 << bits) - 1 if self._left > -bits else 0

    def exhausted(self) -> bool:
        return self._left <= 0


class SwitchCode:
    """Rice codes for small values, exponential Golomb codes beyond.

    A codebook word has the length of the unary part at which codes switch in
    its high byte, then the order of the exponential and of the Rice part, four
    bits each.
    """

    def __init__(self, codebook: int):
        self.switch, self.exp, self.rice = codebook >> 8, codebook >> 4 & 15, codebook & 15
        self._limit = self.switch + 1 << self.rice
        self._base = self._limit - (1 << self.exp)

    def write(self, out: BitWriter, value: int) -> None:
        if value < self._limit:
            out.put((value >> self.rice) + 1, 1)
            out.put(self.rice, value)
            return
        rest = value - self._base
        # The code has as many leading zeros as its length tells: the width of
        # ``rest`` grows by one for each.
        zeros = rest.bit_length() - 1 - self.exp + self.switch + 1
        out.put(self.exp + 2 * zeros - self.switch, rest)

    def read(self, data: BitReader) -> int:
        zeros = 0
        while not data.get(1):
            zeros += 1
            if data.exhausted():
                raise ValueError("the code is cut short")
        if zeros <= self.switch:
            return zeros << self.rice | data.get(self.rice)
        width = self.exp + zeros - self.switch - 1
        return (1 << width | data.get(width)) + self._base


def signed_fold(n: int) -> int:
    return -2 * n - 1 if n < 0 else 2 * n


def signed_unfold(u: int) -> int:
    return u >> 1 ^ -(u & 1)

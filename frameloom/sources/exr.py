"""OpenEXR images: scan lines of half floats, uncompressed."""

from __future__ import annotations

import struct

import numpy as np


def _attribute(name: str, kind: str, value: bytes) -> bytes:
    return f"{name}\0{kind}\0".encode() + struct.pack("<I", len(value)) + value


def encode(rgb: np.ndarray) -> bytes:
    """``rgb``: height x width x 3 of 16 bits; 65535 becomes 1."""
    height, width, _ = rgb.shape
    half = (rgb.astype(np.float64) / 65535).astype("<f2")
    channels = b"".join(c + b"\0" + struct.pack("<IB3xII", 1, 0, 1, 1) for c in (b"B", b"G", b"R")) + b"\0"
    box = struct.pack("<4i", 0, 0, width - 1, height - 1)
    head = struct.pack("<II", 20000630, 2) + b"".join([
        _attribute("channels", "chlist", channels), _attribute("compression", "compression", b"\0"), _attribute("dataWindow", "box2i", box), _attribute("displayWindow", "box2i", box),
        _attribute("lineOrder", "lineOrder", b"\0"), _attribute("pixelAspectRatio", "float", struct.pack("<f", 1)), _attribute("screenWindowCenter", "v2f", struct.pack("<ff", 0, 0)), _attribute("screenWindowWidth", "float", struct.pack("<f", 1)),
    ]) + b"\0"
    size = width * 6
    first = len(head) + 8 * height
    offsets = struct.pack(f"<{height}Q", *(first + y * (8 + size) for y in range(height)))
    lines = b"".join(struct.pack("<iI", y, size) + half[y, :, ::-1].T.tobytes() for y in range(height))
    return head + offsets + lines


def decode(data: bytes) -> np.ndarray:
    """Half floats, height x width x 3, of a file that ``encode`` wrote."""
    if struct.unpack_from("<I", data)[0] != 20000630:
        raise ValueError("not an OpenEXR file")
    at, box = 8, None
    while data[at]:
        name, kind, rest = data[at:].split(b"\0", 2)
        at += len(name) + len(kind) + 2
        size = struct.unpack_from("<I", data, at)[0]
        if name == b"dataWindow":
            box = struct.unpack_from("<4i", data, at + 4)
        at += 4 + size
    width, height = box[2] - box[0] + 1, box[3] - box[1] + 1
    offsets = struct.unpack_from(f"<{height}Q", data, at + 1)
    lines = [np.frombuffer(data, "<f2", width * 3, o + 8).reshape(3, width)[::-1].T for o in offsets]
    return np.stack(lines)

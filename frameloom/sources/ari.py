"""ARRIRAW frames: a 4096-byte header, then 12 or 13 bits a pixel."""

from __future__ import annotations

import struct

import numpy as np

from .bits import pack, unpack

# The places of header fields, in bytes.
_FIELDS = {"width": 0x14, "height": 0x18, "active_x": 0x24, "active_y": 0x28, "active_w": 0x2C, "active_h": 0x30, "data_offset": 0x44, "data_size": 0x48, "kelvin": 0x5C, "exposure_index": 0x74, "sensor_fps": 0x1A0, "project_fps": 0x1A4}
_GAINS = {"wb_r": 0x64, "wb_g": 0x68, "wb_b": 0x6C, "black_level": 0x78, "white_level": 0x7C}
_MODEL, _HEADER = 0x29C, 4096


def header(data: bytes) -> dict:
    """Raises ValueError where this is no such frame."""
    if len(data) < _HEADER or data[:4] != b"ARRI":
        raise ValueError("not an ARRIRAW frame")
    out = {k: struct.unpack_from("<I", data, at)[0] for k, at in _FIELDS.items()}
    out |= {k: struct.unpack_from("<f", data, at)[0] for k, at in _GAINS.items()}
    if not (0 < out["width"] <= 16384 and 0 < out["height"] <= 16384):
        raise ValueError("impossible dimensions")
    out["data_offset"] = out["data_offset"] or _HEADER
    out["camera"] = data[_MODEL : _MODEL + 63].split(b"\0")[0].decode("latin-1")
    # Thirteen bits if the data is clearly larger than twelve make it.
    out["bits"] = 13 if out["data_size"] > out["width"] * out["height"] * 3 // 2 + 1024 else 12
    return out


def decode(data: bytes) -> tuple[dict, np.ndarray]:
    """The header and pixels scaled to 16 bits, red first."""
    info = header(data)
    at, n = info["data_offset"], info["width"] * info["height"]
    values = unpack(data[at : at + info["data_size"]], info["bits"], n, little_words=True)
    return info, (values << (16 - info["bits"])).reshape(info["height"], info["width"])


def encode(pixels: np.ndarray, *, bits: int = 12, camera: str = "", **fields) -> bytes:
    """A frame that ``decode`` reads back, but for the bits that don't fit."""
    body = pack(pixels.ravel().astype(np.uint32) >> (16 - bits), bits, little_words=True)
    if bits == 13 and len(body) <= pixels.size * 3 // 2 + 1024:
        body += bytes(pixels.size * 3 // 2 + 1025 - len(body))
    head = bytearray(_HEADER)
    head[:4] = b"ARRI"
    values = {"height": pixels.shape[0], "width": pixels.shape[1], "data_offset": _HEADER, "data_size": len(body)} | fields
    for k, v in values.items():
        struct.pack_into("<I" if k in _FIELDS else "<f", head, _FIELDS.get(k, _GAINS.get(k)), v)
    head[_MODEL : _MODEL + 63] = camera.encode("latin-1")[:63].ljust(63, b"\0")
    return bytes(head) + body

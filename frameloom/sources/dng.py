"""CinemaDNG frames: TIFF with a colour filter array, plain or lossless JPEG."""

from __future__ import annotations

import struct

import numpy as np

from .bits import unpack

# TIFF and DNG tags, and bytes of TIFF's types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SUB_IFDS = 322, 323, 324, 325, 330
MAKE, MODEL, CFA_SIZE, CFA_PATTERN, ISO, DNG_VERSION, UNIQUE_MODEL, BLACK, WHITE, NEUTRAL = 271, 272, 33421, 33422, 34855, 50706, 50708, 50714, 50717, 50728
CFA_PHOTOMETRIC = 32803
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}
#: Rows and columns that a pattern lies off red-first.
SHIFTS = {(0, 1, 1, 2): (0, 0), (1, 0, 2, 1): (0, 1), (1, 2, 0, 1): (1, 0), (2, 1, 1, 0): (1, 1)}


def directories(data: bytes) -> list[dict]:
    """The tags of the first directory and of those below it."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")

    def read(at: int) -> dict:
        out = {"order": order}
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = _SIZES.get(kind, 1) * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            if kind == 2:
                out[tag] = data[place : place + count].split(b"\0")[0].decode("latin-1")
            elif kind in (5, 10):
                parts = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", data, place)
                out[tag] = tuple(a / b if b else 1.0 for a, b in zip(parts[::2], parts[1::2]))
            else:
                out[tag] = struct.unpack_from(f"{order}{count}{_CODES.get(kind, 'B')}", data, place)
        return out

    first = read(struct.unpack_from(order + "I", data, 4)[0])
    return [first, *(read(at) for at in first.get(SUB_IFDS, ()))]


def raw_directory(data: bytes) -> dict:
    """The directory with the mosaic; camera and neutral come from the first."""
    found = directories(data)
    raw = next((d for d in found if d.get(PHOTOMETRIC) == (CFA_PHOTOMETRIC,)), found[0])
    return {k: v for k, v in found[0].items() if k in (MAKE, MODEL, UNIQUE_MODEL, ISO, NEUTRAL)} | raw


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def lossless_jpeg(data: bytes) -> np.ndarray:
    """Rows of samples, components interleaved; predictors 1 to 7."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    at, tables, precision, size, use = 2, {}, 16, None, []
    while True:
        marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC3:
            precision, height, width, components = body[0], *struct.unpack_from(">HH", body, 1), body[5]
            size = (height, width, components)
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] & 15] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDA:
            use = [body[2 + 2 * i] >> 4 for i in range(body[0])]
            predictor, shift = body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15
            break
    if size is None or not tables:
        raise ValueError("the stream lacks a frame header or tables")
    height, width, components = size
    scan = data[at:].replace(b"\xff\x00", b"\xff")
    books = [tables.get(u, tables[min(tables)]) for u in use]
    # A window of 16 bits gives symbol and length at once.
    lookups = []
    for book in books:
        look = np.zeros((1 << 16, 2), np.uint8)
        for (length, code), symbol in book.items():
            look[code << (16 - length) : code + 1 << (16 - length)] = (symbol, length)
        lookups.append(look.tolist())
    bits, have, pos, total = 0, 0, 0, len(scan)
    out = np.zeros((height, width, components), np.int64)
    mask, first = (1 << precision) - 1, 1 << precision - shift - 1
    above = None
    for y in range(height):
        line = [[0] * components for _ in range(width)]
        for x in range(width):
            for c in range(components):
                while have < 48:
                    bits, have = bits << 8 | (scan[pos] if pos < total else 0), have + 8
                    pos += 1
                symbol, length = lookups[c][bits >> have - 16 & 0xFFFF]
                have -= length or 16
                diff = 0
                if symbol == 16:
                    diff = 32768
                elif symbol:
                    have -= symbol
                    diff = bits >> have & (1 << symbol) - 1
                    if diff < 1 << symbol - 1:
                        diff -= (1 << symbol) - 1
                bits &= (1 << have) - 1
                if x == 0:
                    guess = first if above is None else above[0][c]
                elif above is None:
                    guess = line[x - 1][c]
                else:
                    a, b, d = line[x - 1][c], above[x][c], above[x - 1][c]
                    guess = (a, a, b, d, a + b - d, a + (b - d >> 1), b + (a - d >> 1), a + b >> 1)[predictor if predictor < 8 else 1]
                line[x][c] = guess + diff & mask
        out[y] = line
        above = line
    return (out << shift).reshape(height, width * components)


def decode(data: bytes, *, mosaic: bool = True) -> tuple[dict, np.ndarray]:
    """The tags and the mosaic in 16 bits, red first unless ``mosaic`` is false.

    12- and 14-bit samples are shifted up.  A lossless stream may hold several
    rows of its tile in one of its own.
    """
    tags = raw_directory(data)
    width, height, bits = tags[WIDTH][0], tags[HEIGHT][0], tags[BITS][0]
    tiled = TILE_OFFSETS in tags
    tw, th = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, tags.get(ROWS_PER_STRIP, (height,))[0])
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    across = -(-width // tw)
    out = np.zeros((height, width), np.uint16)
    for i, (at, size) in enumerate(zip(offsets, sizes)):
        y, x = i // across * th, i % across * tw
        rows = th if tiled else min(th, height - y)
        if tags.get(COMPRESSION, (1,))[0] == 7:
            flat = lossless_jpeg(data[at : at + size]).ravel()
            block = np.zeros(rows * tw, np.int64)
            block[: len(flat)] = flat[: rows * tw]
        elif bits == 16:
            block = np.frombuffer(data, tags["order"] + "u2", rows * tw, at)
        else:
            block = unpack(data[at : at + size], bits, rows * tw)
        block = block.reshape(rows, tw)[: height - y, : width - x]
        out[y : y + block.shape[0], x : x + block.shape[1]] = block
    if bits < 16:
        out <<= 16 - bits
    dy, dx = SHIFTS.get(tuple(tags.get(CFA_PATTERN, (0, 1, 1, 2))), (0, 0))
    if mosaic and (dy or dx):
        moved = np.zeros_like(out)
        moved[: height - dy, : width - dx] = out[dy:, dx:]
        out = moved
    return tags, out


def encode(pixels: np.ndarray, *, camera: str = "frameloom", iso: int = 0, pattern: tuple[int, ...] = (0, 1, 1, 2)) -> bytes:
    """An uncompressed 16-bit frame of one strip; ``pixels`` are red first, and
    are moved back to ``pattern``."""
    height, width = pixels.shape
    dy, dx = SHIFTS[pattern]
    back = np.zeros_like(pixels, dtype="<u2")
    back[dy:, dx:] = pixels[: height - dy, : width - dx]
    model = camera.encode("latin-1") + b"\0"
    longs = lambda *v: struct.pack(f"<{len(v)}I", *v)
    shorts = lambda *v: struct.pack(f"<{len(v)}H", *v)
    entries = {
        WIDTH: (4, longs(width)), HEIGHT: (4, longs(height)), BITS: (3, shorts(16)), COMPRESSION: (3, shorts(1)), PHOTOMETRIC: (3, shorts(CFA_PHOTOMETRIC)), MODEL: (2, model),
        STRIP_OFFSETS: (4, longs(0)), SAMPLES: (3, shorts(1)), ROWS_PER_STRIP: (4, longs(height)), STRIP_BYTES: (4, longs(back.nbytes)), CFA_SIZE: (3, shorts(2, 2)),
        CFA_PATTERN: (1, bytes(pattern)), ISO: (3, shorts(iso)), DNG_VERSION: (1, bytes((1, 4, 0, 0))), UNIQUE_MODEL: (2, model), BLACK: (4, longs(0)), WHITE: (4, longs(65535)),
    }
    place = 8 + 2 + 12 * len(entries) + 4
    spill, table = b"", b""
    for tag in sorted(entries):
        kind, value = entries[tag]
        count = len(value) // _SIZES[kind]
        if tag == STRIP_OFFSETS:
            table += struct.pack("<HHI", tag, kind, count) + b"@@@@"
        elif len(value) <= 4:
            table += struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")
        else:
            table += struct.pack("<HHII", tag, kind, count, place + len(spill))
            spill += value + b"\0" * (len(value) % 2)
    head = b"II*\0" + longs(8) + shorts(len(entries)) + table + longs(0) + spill
    return head.replace(b"@@@@", longs(len(head)), 1) + back.tobytes()

"""Sample tables of QuickTime movies and MXF files, and a plain movie writer.

A scan gives a row for each frame, with its place in the file, so that frames can
be read in any order and on any machine.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


def atoms(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the content of each atom."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            raise ValueError("a broken atom")
        yield kind, at + head, min(at + size, end)
        at += size


def movie_samples(data: bytes) -> dict | None:
    """``codec``, ``width``, ``height``, ``timescale`` and ``samples`` (offset,
    size) of the first video track; None if there is none."""

    def walk(at: int, end: int, found: dict) -> None:
        for kind, a, b in atoms(data, at, end):
            if kind == b"trak":
                own: dict = {}
                walk(a, b, own)
                if own.get("video") and "codec" in own and "best" not in found:
                    found["best"] = own
            elif kind in _NESTED:
                walk(a, b, found)
            elif kind == b"hdlr":
                found["video"] = found.get("video") or data[a + 8 : a + 12] == b"vide"
            elif kind == b"mdhd":
                found["timescale"] = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
            elif kind == b"stsd" and struct.unpack_from(">I", data, a + 4)[0]:
                found["codec"] = data[a + 12 : a + 16].decode("latin-1")
                found["width"], found["height"] = struct.unpack_from(">HH", data, a + 8 + 32)
            elif kind == b"stsz":
                size, n = struct.unpack_from(">II", data, a + 4)
                found["sizes"] = [size] * n if size else list(struct.unpack_from(f">{n}I", data, a + 12))
            elif kind == b"stsc":
                n = struct.unpack_from(">I", data, a + 4)[0]
                found["runs"] = [struct.unpack_from(">III", data, a + 8 + 12 * i) for i in range(n)]
            elif kind in (b"stco", b"co64"):
                n = struct.unpack_from(">I", data, a + 4)[0]
                found["chunks"] = list(struct.unpack_from(f">{n}{'I' if kind == b'stco' else 'Q'}", data, a + 8))

    top: dict = {}
    walk(0, len(data), top)
    best = top.get("best")
    if not best or "sizes" not in best or "chunks" not in best:
        return None
    samples, i = [], 0
    runs = best.get("runs") or [(1, 1, 1)]
    for c, place in enumerate(best["chunks"], 1):
        per = next(r[1] for r in reversed(runs) if r[0] <= c)
        for _ in range(per):
            if i < len(best["sizes"]):
                samples.append((place, best["sizes"][i]))
                place, i = place + best["sizes"][i], i + 1
    return {k: best.get(k) for k in ("codec", "width", "height", "timescale")} | {"samples": samples}


def write_movie(packets: list[bytes], codec: str, width: int, height: int, *, timescale: int = 24000, duration: int = 1000) -> bytes:
    """A movie of one video track: packets first, the index at the end."""
    atom = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    full = lambda kind, body: atom(kind, b"\0\0\0\0" + body)
    head = atom(b"ftyp", b"qt  \0\0\0\0qt  ")
    body = b"".join(packets)
    wide = struct.pack(">I4sQ", 1, b"mdat", 16 + len(body))
    places, at = [], len(head) + len(wide)
    for p in packets:
        places.append(at)
        at += len(p)
    n, total = len(packets), len(packets) * duration
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = b"\0" * 6 + struct.pack(">H", 1) + b"\0" * 16 + struct.pack(">HHIIIH", width, height, 72 << 16, 72 << 16, 0, 1) + b"\0" * 32 + struct.pack(">Hh", 24, -1)
    table = (
        full(b"stsd", struct.pack(">I", 1) + atom(codec.encode("latin-1"), entry)) + full(b"stts", struct.pack(">III", 1, n, duration)) + full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1))
        + full(b"stsz", struct.pack(">II", 0, n) + struct.pack(f">{n}I", *map(len, packets))) + full(b"co64", struct.pack(">I", n) + struct.pack(f">{n}Q", *places))
    )
    data_reference = atom(b"dinf", full(b"dref", struct.pack(">I", 1) + atom(b"url ", b"\0\0\0\1")))
    media = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, timescale, total, 0, 0)) + full(b"hdlr", b"mhlrvide" + b"\0" * 13) + atom(b"minf", full(b"vmhd", b"\0" * 8) + data_reference + atom(b"stbl", table))
    track = atom(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, total) + b"\0" * 16 + matrix + struct.pack(">II", width << 16, height << 16)) + atom(b"mdia", media))
    header = full(b"mvhd", struct.pack(">IIII", 0, 0, timescale, total) + struct.pack(">IH", 1 << 16, 256) + b"\0" * 10 + matrix + b"\0" * 24 + struct.pack(">I", 2))
    return head + wide + body + atom(b"moov", header + track)


#: The start of every key, and the picture essence of one item.
MXF_KEY, MXF_ESSENCE = bytes.fromhex("060e2b34"), bytes.fromhex("060e2b34010201010d010301")


def ber_length(data: bytes, at: int) -> tuple[int, int]:
    """A length and the bytes that it takes."""
    first = data[at]
    if first < 128:
        return first, 1
    n = first & 127
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), 1 + n


def mxf_frames(data: bytes, magic: bytes = b"ARRI") -> list[tuple[int, int]]:
    """Offset and size of essence elements that start with ``magic``."""
    out, at = [], data.find(MXF_KEY)
    while at >= 0 and at + 17 <= len(data):
        if data[at : at + 4] != MXF_KEY:
            at = data.find(MXF_KEY, at + 1)
            continue
        size, width = ber_length(data, at + 16)
        start = at + 16 + width
        if data[at : at + 12] == MXF_ESSENCE and data[start : start + len(magic)] == magic:
            out.append((start, size))
        at = start + size
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``clip_id, f, offset, size, codec, width, height`` of movies and MXF files;
    a file without a video track gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data[:4] == MXF_KEY:
                    info = {"codec": "mxf", "width": None, "height": None, "samples": mxf_frames(data)}
                else:
                    info = movie_samples(data) or {"samples": []}
                n = len(info["samples"])
                if n:
                    yield pa.RecordBatch.from_pydict({
                        "clip_id": pa.array([file] * n), "f": pa.array(range(n), pa.int32()), "offset": pa.array([s[0] for s in info["samples"]], pa.int64()), "size": pa.array([s[1] for s in info["samples"]], pa.int64()),
                        "codec": pa.array([info["codec"]] * n), "width": pa.array([info["width"]] * n, pa.int32()), "height": pa.array([info["height"]] * n, pa.int32()),
                    })

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "clip_id string, f int, offset long, size long, codec string, width int, height int")


def packets(spark: SparkSession, path: str) -> DataFrame:
    """``clip_id, f, codec, packet`` of the files that ``scan`` finds."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("clip_id"), "content")
    return scan(spark, path).join(files, "clip_id").selectExpr("clip_id", "f", "codec", "substring(content, CAST(offset + 1 AS INT), CAST(size AS INT)) AS packet")

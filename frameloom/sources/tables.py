"""Small files: colour tables (.cube) and hot-pixel profiles."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession


def parse_cube(text: str, name: str = "") -> dict:
    """``title``, ``kind`` ('1D', '3D' or ''), ``size``, ``low``, ``high`` and
    ``rows``; a table whose rows don't match its size has no kind."""
    out = {"title": name, "kind": "", "size": 0, "low": (0.0,) * 3, "high": (1.0,) * 3, "rows": []}
    sizes = {"LUT_1D_SIZE": 0, "LUT_3D_SIZE": 0}
    for line in map(str.strip, text.splitlines()):
        words = line.split()
        if not line or line[0] == "#":
            continue
        if words[0] == "TITLE":
            if line.count('"') >= 2:
                out["title"] = line[line.index('"') + 1 : line.rindex('"')]
        elif words[0] in sizes:
            sizes[words[0]] = int(words[-1]) if words[-1].isdigit() else 0
        elif words[0] in ("DOMAIN_MIN", "DOMAIN_MAX"):
            if len(words) >= 4:
                out["low" if words[0].endswith("MIN") else "high"] = tuple(map(float, words[1:4]))
        elif len(words) >= 3:
            try:
                out["rows"].append(tuple(map(float, words[:3])))
            except ValueError:
                continue
    one, three = sizes["LUT_1D_SIZE"], sizes["LUT_3D_SIZE"]
    if three and len(out["rows"]) == three**3:
        out |= {"kind": "3D", "size": three}
    elif one and len(out["rows"]) == one:
        out |= {"kind": "1D", "size": one}
    return out


def cube_table(spark: SparkSession, cube: dict) -> DataFrame:
    """Rows by index: ``idx, r, g, b``, or ``ri, gi, bi, r, g, b`` red fastest."""
    n = cube["size"]
    if cube["kind"] == "3D":
        return spark.createDataFrame([(i % n, i // n % n, i // (n * n), *row) for i, row in enumerate(cube["rows"])], "ri int, gi int, bi int, r double, g double, b double")
    return spark.createDataFrame([(i, *row) for i, row in enumerate(cube["rows"])], "idx int, r double, g double, b double")


def parse_hot_pixels(data: bytes) -> list[tuple[int, int, int, int]]:
    """``ord, iso, y, x`` of a profile; what is cut short is left out."""
    if data[:4] != b"HPXL" or len(data) < 12:
        raise ValueError("not a hot-pixel profile")
    blocks, at, out = struct.unpack_from("<4H", data, 4)[2], 12, []
    for i in range(blocks):
        if at + 8 > len(data):
            break
        iso, n = struct.unpack_from("<II", data, at)
        at += 8
        for _ in range(n):
            if at + 4 <= len(data):
                out.append((i, iso, *struct.unpack_from("<HH", data, at)))
            at += 4
    return out


def write_hot_pixels(width: int, height: int, blocks: list[tuple[int, list[tuple[int, int]]]]) -> bytes:
    out = b"HPXL" + struct.pack("<4H", width, height, len(blocks), 0)
    for iso, sites in blocks:
        out += struct.pack("<II", iso, len(sites)) + b"".join(struct.pack("<HH", y, x) for y, x in sites)
    return out

"""Temporal filters over frame rows, for clips of any length and size.

A frame is cut into tiles and the time line into chunks.  A tile travels to its
own chunk and to those whose windows reach it, so that a task holds one tile's
chunk and its margins, ``chunk + 2 * window`` small images, whatever the clip.
Shuffled bytes are the clip's times ``1 + 2 * (window - 1) / chunk`` at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import apply, window_of

_TILE = "clip_id string, chunk int, ty int, tx int, f int, n int, height int, width int, data binary"


def denoise(frames: DataFrame, technique: str, sigma: float, *, window: int = 15, tile: int = 256, chunk: int = 32) -> DataFrame:
    """Denoised frame rows.  Frames of a clip have one size and are numbered from
    0 without gaps; rows without data count as missing and end a clip's use."""
    frames = frames.where("data IS NOT NULL")
    lengths = frames.groupBy("clip_id").agg(F.count("*").cast("int").alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for clip, f, n, height, width, data in zip(*(c.to_pylist() for c in batch.columns)):
                pixels = np.frombuffer(data, "<u2").reshape(height, width)
                # Chunks with a frame whose window holds this one.
                reach = [c for c in range((n - 1) // chunk + 1) if _holds(c, f, n, window, chunk)]
                rows = [(clip, c, ty, tx, f, n, height, width, pixels[ty : ty + tile, tx : tx + tile].tobytes()) for ty in range(0, height, tile) for tx in range(0, width, tile) for c in reach]
                yield _batch(rows, _TILE)

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["f"])
        first = rows[0]
        n, height, width, ty, tx = (first[k] for k in ("n", "height", "width", "ty", "tx"))
        shape = (min(tile, height - ty), min(tile, width - tx))
        at = {r["f"]: i for i, r in enumerate(rows)}
        stack = np.stack([np.frombuffer(r["data"], "<u2").reshape(shape) for r in rows])
        out = []
        for f in range(first["chunk"] * chunk, min(n, (first["chunk"] + 1) * chunk)):
            lo, w = window_of(f, n, window)
            near = stack[at[lo] : at[lo] + w]
            out.append((first["clip_id"], first["chunk"], ty, tx, f, n, height, width, apply(technique, near, f - lo, sigma, ty, tx, height, width).tobytes()))
        return pa.Table.from_batches([_batch(out, _TILE)])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        height, width = rows[0]["height"], rows[0]["width"]
        out = np.zeros((height, width), "<u2")
        for r in rows:
            block = np.frombuffer(r["data"], "<u2").reshape(min(tile, height - r["ty"]), -1)
            out[r["ty"] : r["ty"] + block.shape[0], r["tx"] : r["tx"] + block.shape[1]] = block
        return pa.Table.from_batches([_batch([(rows[0]["clip_id"], rows[0]["f"], width, height, out.tobytes())], "clip_id string, f int, width int, height int, data binary")])

    pieces = frames.join(lengths, "clip_id").select("clip_id", "f", "n", "height", "width", "data").mapInArrow(cut, _TILE)
    solved = pieces.groupBy("clip_id", "chunk", "ty", "tx").applyInArrow(solve, _TILE)
    return solved.groupBy("clip_id", "f").applyInArrow(join, "clip_id string, f int, width int, height int, data binary")


def _holds(c: int, f: int, n: int, window: int, chunk: int) -> bool:
    first, last = c * chunk, min(n, (c + 1) * chunk) - 1
    return window_of(first, n, window)[0] <= f < sum(window_of(last, n, window))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[f for f, _ in fields])

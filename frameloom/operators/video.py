"""YUV conversions, film grain, luma fill, blends and the recursive filter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import apply, window_of


def rgb_to_yuv422(rgb: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``f, y, xc, y0, y1, cb, cr``: 10 bits, a row for each pair of pixels."""
    pairs = rgb.selectExpr(*by, "f", "y", "x DIV 2 AS xc", "x % 2 AS side", "r", "g", "b").groupBy(*by, "f", "y", "xc").agg(
        *(F.expr(f"max(CASE WHEN side = {s} THEN {c} END)").alias(f"{c}{s}") for s in (0, 1) for c in "rgb")).where("r1 IS NOT NULL AND r0 IS NOT NULL")
    pairs = pairs.withColumns({f"l{s}": F.expr(f"CAST(0.2126D * r{s} + 0.7152D * g{s} + 0.0722D * b{s} AS INT)") for s in (0, 1)})
    chroma = lambda c, k: f"shiftright(least(65535, greatest(0, CAST((CAST(({c}0 + {c}1) DIV 2 AS INT) - CAST((l0 + l1) DIV 2 AS INT)) * {k}D AS INT) + 32768)), 6)"
    return pairs.selectExpr(*by, "f", "y", "CAST(xc AS INT) AS xc", "shiftright(least(65535, greatest(0, l0)), 6) AS y0", "shiftright(least(65535, greatest(0, l1)), 6) AS y1", f"{chroma('b', 0.5389)} AS cb", f"{chroma('r', 0.635)} AS cr")


def yuv422_to_rgb(yuv: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``f, y, x, r, g, b`` of pairs with 16-bit values."""
    both = yuv.selectExpr(*by, "f", "y", "xc", "cb - 32768 AS u", "cr - 32768 AS w", "stack(2, 0, y0, 1, y1) AS (side, l)")
    clip = lambda e: f"least(65535, greatest(0, {e}))"
    return both.selectExpr(*by, "f", "y", "CAST(xc * 2 + side AS INT) AS x", f"{clip('l + CAST(1.5748D * w AS INT)')} AS r", f"{clip('l - CAST(0.1873D * u AS INT) - CAST(0.4681D * w AS INT)')} AS g", f"{clip('l + CAST(1.8556D * u AS INT)')} AS b")


def mosaic_to_rgb(clip: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``f, y, x, r, g, b`` of 2 x 2 cells: red and blue as they are, the mean
    green, for all four sites."""
    cells = clip.selectExpr(*by, "f", "y DIV 2 AS cy", "x DIV 2 AS cx", "(y % 2) * 2 + x % 2 AS c", "v").groupBy(*by, "f", "cy", "cx").agg(
        *(F.expr(f"max(CASE WHEN c = {k} THEN v END)").alias(f"c{k}") for k in range(4)))
    return cells.selectExpr(*by, "f", "cy", "cx", "c0 AS r", "CAST((c1 + c2) DIV 2 AS INT) AS g", "c3 AS b", "stack(4, 0, 0, 0, 1, 1, 0, 1, 1) AS (oy, ox)").selectExpr(*by, "f", "CAST(cy * 2 + oy AS INT) AS y", "CAST(cx * 2 + ox AS INT) AS x", "r", "g", "b")


# A linear congruential generator modulo 2^32.
_A, _C, _M = 1664525, 1013904223, 1 << 32


def _product(a: str, s: str) -> str:
    """a * s modulo 2^32 without leaving 64 bits."""
    return f"(((({a} DIV 65536) * {s}) % 65536) * 65536 + ({a} % 65536) * {s})"


def random_state(seed: str, k: str) -> str:
    """The generator's state after ``k`` steps from ``seed``: jumps of powers of
    two, so that no pixel waits for the one before."""
    steps, a, c = [], _A, _C
    for j in range(32):
        steps.append(f"struct({1 << j}L AS j, {a}L AS a, {c}L AS c)")
        a, c = a * a % _M, (a * c + c) % _M
    return f"aggregate(array({', '.join(steps)}), CAST({seed} AS BIGINT), (s, q) -> CASE WHEN ({k} DIV q.j) % 2 = 1 THEN ({_product('q.a', 's')} + q.c) % {_M}L ELSE s END)"


def film_grain(clip: DataFrame, amount: float, width: int, *, height: int, seed: int = 12345, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds grain that grows with the signal: three uniform draws a pixel, from a
    generator that starts anew for each frame."""
    first = clip.withColumn("s1", F.expr(random_state(f"({seed} + f)", f"((y * {width} + x) * 3L + 1L)")))
    for k in (2, 3):
        first = first.withColumn(f"s{k}", F.expr(f"({_product(f'{_A}L', f's{k - 1}')} + {_C}L) % {_M}L"))
    draw = " + ".join(f"(s{k} DIV 65536) - 32768" for k in (1, 2, 3))
    scale = f"{amount * 400}D * (0.3D + 0.7D * (v / 65535D))"
    return first.selectExpr(*by, "f", "y", "x", f"least(65535, greatest(0, v + CAST(({draw}) / (32768D * 1.732D) * ({scale}) AS INT))) AS v")


def luma_fill(clip: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Greens as they are; red and blue sites get the truncated mean of the
    greens beside them.  ``residual`` is the site less that, plus 2048."""
    green = clip.where("y % 2 <> x % 2")
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("oy"), F.lit(b).alias("ox")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))))
    told = green.select(*by, "f", "y", "x", "v", steps.alias("o")).selectExpr(*by, "f", "y + o.oy AS y", "x + o.ox AS x", "v")
    means = told.groupBy(*by, "f", "y", "x").agg(F.expr("CAST(sum(v) DIV count(*) AS INT)").alias("m"))
    both = clip.join(means, [*by, "f", "y", "x"], "left")
    return both.selectExpr(*by, "f", "y", "x", "CASE WHEN y % 2 <> x % 2 THEN v ELSE coalesce(m, v) END AS luma", "CASE WHEN y % 2 <> x % 2 THEN 2048 ELSE v - coalesce(m, v) + 2048 END AS residual")


def blend_schedule(noise: str, motion: str) -> dict[str, str]:
    """Strength of a post-filter, and of its second pass where there is one."""
    by_noise = f"CASE WHEN {noise} > 80D THEN 0.9D + 0.1D * least(1D, ({noise} - 80D) / 100D) ELSE 0.9D END"
    by_motion = f"CASE WHEN {motion} > 0D THEN 0.65D + 0.1D * least(1D, {motion} / 5D) ELSE 0D END"
    return {
        "blend": f"greatest({by_noise}, {by_motion})",
        "second": f"({noise} > 120D OR {motion} > 4D)",
        "second_blend": f"CASE WHEN {noise} > 120D THEN 0.3D + 0.2D * least(1D, ({noise} - 120D) / 60D) ELSE 0.4D END",
    }


def lifting_53(lines: DataFrame, keys: list[str], n: int, *, inverse: bool = False) -> DataFrame:
    """Integer 5/3 lifting along ``i`` of lines of ``n`` (even) values; the bands
    are ``low`` and ``high`` of each pair ``p``.  The inverse gives ``i, v``."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("p")
    if not inverse:
        pairs = lines.groupBy(*keys, F.expr("CAST(i DIV 2 AS INT)").alias("p")).agg(F.expr("max(CASE WHEN i % 2 = 0 THEN v END)").alias("a"), F.expr("max(CASE WHEN i % 2 = 1 THEN v END)").alias("b"))
        high = pairs.withColumn("high", F.expr("b") - F.shiftright(F.col("a") + F.coalesce(F.lead("a").over(w), "a"), 1))
        return high.withColumn("low", F.col("a") + F.shiftright(F.coalesce(F.lag("high").over(w), "high") + F.col("high") + 2, 2)).select(*keys, "p", "low", "high")
    even = lines.withColumn("a", F.col("low") - F.shiftright(F.coalesce(F.lag("high").over(w), "high") + F.col("high") + 2, 2))
    both = even.withColumn("b", F.col("high") + F.shiftright(F.col("a") + F.coalesce(F.lead("a").over(w), "a"), 1))
    return both.selectExpr(*keys, "p", "stack(2, 0, a, 1, b) AS (side, v)").selectExpr(*keys, "CAST(p * 2 + side AS INT) AS i", "v")


def recursive(frames: DataFrame, technique: str, sigma: float, *, window: int = 15, tile: int = 256) -> DataFrame:
    """Frames in order, windows reading what was denoised already in place of
    earlier frames.

    A frame needs the ones before it, so time isn't split: the work of a clip is
    spread over its tiles, and a task holds one tile of the clip's frames.
    """
    schema = "clip_id string, ty int, tx int, f int, height int, width int, data binary"

    def cut(batches):
        for batch in batches:
            for clip, f, height, width, data in zip(*(c.to_pylist() for c in batch.columns)):
                pixels = np.frombuffer(data, "<u2").reshape(height, width)
                spots = [(ty, tx) for ty in range(0, height, tile) for tx in range(0, width, tile)]
                yield pa.RecordBatch.from_pydict({
                    "clip_id": pa.array([clip] * len(spots), pa.string()), "ty": pa.array([s[0] for s in spots], pa.int32()), "tx": pa.array([s[1] for s in spots], pa.int32()),
                    "f": pa.array([f] * len(spots), pa.int32()), "height": pa.array([height] * len(spots), pa.int32()), "width": pa.array([width] * len(spots), pa.int32()),
                    "data": pa.array([pixels[ty : ty + tile, tx : tx + tile].tobytes() for ty, tx in spots], pa.binary()),
                })

    def solve(key, table):
        table = table.sort_by("f")
        height, width, ty, tx = (table.column(c)[0].as_py() for c in ("height", "width", "ty", "tx"))
        shape = (min(tile, height - ty), min(tile, width - tx))
        stack = np.stack([np.frombuffer(d.as_py(), "<u2").reshape(shape) for d in table.column("data")])
        for f in range(len(stack)):
            lo, w = window_of(f, len(stack), window)
            stack[f] = apply(technique, stack[lo : lo + w], f - lo, sigma, ty, tx, height, width)
        return table.set_column(table.schema.get_field_index("data"), "data", pa.array([s.tobytes() for s in stack], pa.binary()))

    pieces = frames.where("data IS NOT NULL").select("clip_id", "f", "height", "width", "data").mapInArrow(cut, schema)
    solved = pieces.groupBy("clip_id", "ty", "tx").applyInArrow(solve, schema)

    def join(key, table):
        rows = table.to_pylist()
        height, width = rows[0]["height"], rows[0]["width"]
        out = np.zeros((height, width), "<u2")
        for r in rows:
            block = np.frombuffer(r["data"], "<u2").reshape(min(tile, height - r["ty"]), -1)
            out[r["ty"] : r["ty"] + block.shape[0], r["tx"] : r["tx"] + block.shape[1]] = block
        return pa.table({"clip_id": pa.array([rows[0]["clip_id"]], pa.string()), "f": pa.array([rows[0]["f"]], pa.int32()), "width": pa.array([width], pa.int32()), "height": pa.array([height], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    return solved.groupBy("clip_id", "f").applyInArrow(join, "clip_id string, f int, width int, height int, data binary")

"""Block matching between frames' green planes, and motion statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a pixel outside either frame adds to a block's distance.
OUTSIDE = 32768


def green_plane(clip: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``f, y, x, v`` at half size: the truncated mean of a cell's greens."""
    from .calibration import green_pairs

    return green_pairs(clip, by=by).selectExpr(*by, "f", "CAST(cy AS INT) AS y", "CAST(cx AS INT) AS x", "CAST((gr + gb) DIV 2 AS INT) AS v")


def downsample(plane: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Truncated means of whole 2 x 2 cells."""
    cells = plane.groupBy(*by, "f", F.expr("CAST(y DIV 2 AS INT)").alias("cy"), F.expr("CAST(x DIV 2 AS INT)").alias("cx")).agg(F.sum("v").alias("s"), F.count("*").alias("k")).where("k = 4")
    return cells.selectExpr(*by, "f", "cy AS y", "cx AS x", "CAST(s DIV 4 AS INT) AS v")


def _distances(plane: DataFrame, starts: DataFrame, block: int, by: tuple[str, ...], half: bool) -> DataFrame:
    """``f, nf, gy, gx, dy, dx, sad`` of candidate displacements of blocks.

    ``starts``: ``f, nf, gy, gx, dy, dx``.  Pixels of a block are joined with the
    candidates on the block, and then with the other frame on the place that
    they are moved to; what finds no partner counts as outside.
    """
    keys = [*by, "f"]
    cur = plane.selectExpr(*keys, "y", "x", "v", f"CAST(y DIV {block} AS INT) AS gy", f"CAST(x DIV {block} AS INT) AS gx")
    aimed = cur.join(starts, [*keys, "gy", "gx"])
    if not half:
        moved = aimed.withColumns({"ny": F.expr("y + dy"), "nx": F.expr("x + dx")})
        other = plane.select(*by, F.col("f").alias("nf"), F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("v").alias("o"))
        both = moved.join(other, [*by, "nf", "ny", "nx"], "left")
        cost = f"CASE WHEN o IS NULL THEN {OUTSIDE} ELSE abs(v - o) END"
    else:
        # Displacements in halves: the mean of the 1, 2 or 4 pixels around.
        moved = aimed.withColumns({"fy": F.expr("dy & 1"), "fx": F.expr("dx & 1"), "ny": F.expr("y + shiftright(dy, 1)"), "nx": F.expr("x + shiftright(dx, 1)")})
        corners = "transform(filter(array(struct(0 AS a, 0 AS b), struct(0 AS a, 1 AS b), struct(1 AS a, 0 AS b), struct(1 AS a, 1 AS b)), c -> c.a <= fy AND c.b <= fx), c -> struct(ny + c.a AS cy, nx + c.b AS cx))"
        spread = moved.withColumn("c", F.explode(F.expr(corners))).withColumns({"cy": F.col("c.cy"), "cx": F.col("c.cx")})
        other = plane.select(*by, F.col("f").alias("nf"), F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("v").alias("o"))
        both = spread.join(other, [*by, "nf", "cy", "cx"], "left")
        both = both.groupBy(*keys, "nf", "gy", "gx", "dy", "dx", "fy", "fx", "y", "x", "v").agg(F.sum("o").alias("s"), F.count("o").alias("k"))
        cost = f"CASE WHEN k < (fy + 1) * (fx + 1) THEN {OUTSIDE} ELSE abs(v - (s + k DIV 2) DIV k) END"
    return both.groupBy(*keys, "nf", "gy", "gx", "dy", "dx").agg(F.sum(F.expr(cost)).cast("long").alias("sad"))


def _best(costs: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """The least distance; of equal ones the first in search order."""
    return costs.groupBy(*by, "f", "nf", "gy", "gx").agg(F.expr(f"min_by(struct(dy, dx, sad), struct(sad, {order}))").alias("b")).select(*by, "f", "nf", "gy", "gx", "b.dy", "b.dx", "b.sad")


def _square(radius: int) -> str:
    return f"transform(sequence(0, {(2 * radius + 1) ** 2 - 1}), i -> struct(CAST(i DIV {2 * radius + 1} - {radius} AS INT) AS oy, CAST(i % {2 * radius + 1} - {radius} AS INT) AS ox))"


def search(plane: DataFrame, starts: DataFrame, block: int, radius: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Full search around each start; ``starts``: ``f, nf, gy, gx, dy, dx``."""
    candidates = starts.withColumn("o", F.explode(F.expr(_square(radius)))).selectExpr(*by, "f", "nf", "gy", "gx", "dy + o.oy AS dy", "dx + o.ox AS dx")
    return _best(_distances(plane, candidates, block, by, False), by, "dy, dx")


def refine_half(plane: DataFrame, found: DataFrame, block: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Nine candidates half a pixel apart; the start wins ties.  Result in halves."""
    candidates = found.withColumn("o", F.explode(F.expr(_square(1)))).selectExpr(*by, "f", "nf", "gy", "gx", "dy * 2 + o.oy AS dy", "dx * 2 + o.ox AS dx", "abs(o.oy) + abs(o.ox) > 0 AS moved")
    costs = _distances(plane, candidates.drop("moved"), block, by, True)
    costs = costs.join(candidates, [*by, "f", "nf", "gy", "gx", "dy", "dx"])
    return _best(costs, by, "moved, dy, dx")


def estimate(plane: DataFrame, pairs: DataFrame, block: int, height: int, width: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Motion of blocks of ``f`` towards ``nf``: a pyramid of three levels,
    searched by 8, 4 and 2 pixels, then half a pixel.  Result in halves."""
    half_plane = downsample(plane, by=by)
    quarter = downsample(half_plane, by=by)
    b1, b2 = max(2, block // 2), max(2, block // 4)
    grid = F.explode(F.expr(f"transform(sequence(0, {(height // block) * (width // block) - 1}), i -> struct(CAST(i DIV {width // block} AS INT) AS gy, CAST(i % {width // block} AS INT) AS gx))"))
    found = pairs.withColumn("g", grid).selectExpr(*by, "f", "nf", "g.gy", "g.gx", "0 AS dy", "0 AS dx")
    for level, size, radius in ((quarter, b2, 8), (half_plane, b1, 4), (plane, block, 2)):
        found = search(level, found.selectExpr(*by, "f", "nf", "gy", "gx", "dy", "dx"), size, radius, by=by)
        if level is not plane:
            found = found.selectExpr(*by, "f", "nf", "gy", "gx", "dy * 2 AS dy", "dx * 2 AS dx")
    return refine_half(plane, found, block, by=by)


def motion_stats(vectors: DataFrame, scale: float = 0.5, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``pairs, median, largest``: the upper median and the maximum over frame
    pairs of their mean displacement."""
    pairs = vectors.groupBy(*by, "f", "nf").agg(F.expr(f"avg(sqrt(dx * dx + dy * dy) * {scale}D)").alias("m"))
    # In falling order the discrete median is the upper one.
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY m DESC)")
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), median.alias("median"), F.max("m").alias("largest"))


def centre_weight(flow: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``f, weight``: 0.3, and up to 0.6 at a mean motion of 3 pixels, of every
    16th flow cell with under 20."""
    sampled = flow.where("cell % 16 = 0 AND mag < 20D")
    means = sampled.groupBy(*by, "f", "nf").agg(F.avg("mag").alias("m"))
    return means.groupBy(*by, "f").agg(F.expr("0.3D + 0.3D * least(1D, avg(m) / 3D)").alias("weight"))


def window_for(motion: str = "m") -> str:
    """Frames of a window by mean motion."""
    return f"CASE WHEN {motion} < 2D THEN 15 WHEN {motion} < 5D THEN 9 ELSE 5 END"

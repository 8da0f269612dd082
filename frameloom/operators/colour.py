"""Previews, luma, histograms, lookup tables and camera dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.formulas import luma


def preview(clip: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """8-bit RGB at half size: one aggregation over cells."""
    cells = clip.selectExpr(*by, "f", "y DIV 2 AS cy", "x DIV 2 AS cx", "(y % 2) * 2 + x % 2 AS c", "v")
    grouped = cells.groupBy(*by, "f", "cy", "cx").agg(*(F.expr(f"max(CASE WHEN c = {k} THEN v END)").alias(f"c{k}") for k in range(4)))
    return grouped.selectExpr(*by, "f", "CAST(cy AS INT) AS y", "CAST(cx AS INT) AS x", "shiftright(c0, 8) AS r", "shiftright(CAST((c1 + c2) DIV 2 AS INT), 8) AS g", "shiftright(c3, 8) AS b")


def luma_of(rgb: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    return rgb.selectExpr(*by, "f", "y", "x", f"{luma('r', 'g', 'b')} AS v")


def histogram(rgb: DataFrame, bins: int = 256, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``f, channel, bin, n, share`` of 8-bit channels and their luma; ``share``
    is of the largest bin but the first and last.  Empty bins have 0."""
    channels = "stack(4, 'r', r, 'g', g, 'b', b, 'l', CAST((r * 2126 + g * 7152 + b * 722) DIV 10000 AS INT)) AS (channel, bin)"
    counts = rgb.selectExpr(*by, "f", channels).groupBy(*by, "f", "channel", "bin").agg(F.count("*").alias("n"))
    # Frames times channels rows, times 256: the zero-filled grid.
    grid = counts.select(*by, "f", "channel").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts, [*by, "f", "channel", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    top = F.max(F.expr(f"CASE WHEN bin BETWEEN 1 AND {bins - 2} THEN n END")).over(Window.partitionBy(*by, "f", "channel"))
    return full.withColumn("top", top).selectExpr(*by, "f", "channel", "bin", "n", "round(CASE WHEN top > 0 THEN least(1D, n / CAST(top AS DOUBLE)) ELSE 0D END, 6) AS share")


def waveform(rgb: DataFrame, levels: int = 64, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``f, x, level, n``: how often a column of the luma has each level."""
    values = rgb.selectExpr(*by, "f", "x", f"CAST({luma('r', 'g', 'b')} * {levels} DIV 65536 AS INT) AS level")
    return values.groupBy(*by, "f", "x", "level").agg(F.count("*").alias("n"))


def lut1d(clip: DataFrame, lut: DataFrame, size: int, blend: float = 1.0, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Linear interpolation in ``lut(idx, v)`` (values 0 to 1) over 16-bit input;
    a table has at most 65536 rows, so it is sent to every task."""
    pos = clip.withColumn("p", F.expr(f"v / 65535D * {size - 1}D")).withColumn("i", F.expr(f"least(CAST(floor(p) AS INT), {max(0, size - 2)})"))
    pairs = lut.select(F.col("idx").alias("i"), F.col("v").alias("lo"), F.lead("v", 1).over(Window.orderBy("idx")).alias("hi"))
    both = pos.join(F.broadcast(pairs), "i")
    mapped = "(lo + (coalesce(hi, lo) - lo) * (p - i))"
    return both.selectExpr(*by, "f", "y", "x", f"CAST(floor(least(65535D, greatest(0D, ({mapped} * {blend}D + v / 65535D * {1 - blend}D) * 65535D)) + 0.5D) AS INT) AS v")


def lut3d(rgb: DataFrame, lut: DataFrame, size: int, blend: float = 1.0, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Trilinear interpolation in ``lut(ri, gi, bi, r, g, b)``, values 0 to 1.

    The table travels as one array, red fastest; a pixel reads its 8 corners by
    index.  ``size`` is at most 65, as .cube files go.
    """
    table = lut.groupBy().agg(F.expr("transform(array_sort(collect_list(struct(bi, gi, ri, r, g, b))), q -> struct(q.r, q.g, q.b))").alias("t"))
    pos = rgb
    for c in "rgb":
        pos = pos.withColumn(f"p{c}", F.expr(f"{c} / 65535D * {size - 1}D")).withColumn(f"{c}0", F.expr(f"least(CAST(floor(p{c}) AS INT), {max(0, size - 2)})")).withColumn(f"t{c}", F.expr(f"p{c} - {c}0"))
    both = pos.crossJoin(F.broadcast(table))

    def mapped(channel: str) -> str:
        terms = []
        for dr in (0, 1):
            for dg in (0, 1):
                for db in (0, 1):
                    weight = " * ".join(f"t{c}" if d else f"(1D - t{c})" for c, d in zip("rgb", (dr, dg, db)))
                    terms.append(f"{weight} * element_at(t, (b0 + {db}) * {size * size} + (g0 + {dg}) * {size} + r0 + {dr} + 1).{channel}")
        return "(" + " + ".join(terms) + ")"

    out = (f"CAST(floor(least(65535D, greatest(0D, ({mapped(c)} * {blend}D + {c} / 65535D * {1 - blend}D) * 65535D)) + 0.5D) AS INT) AS {c}" for c in "rgb")
    return both.selectExpr(*by, "f", "y", "x", *out)


def interpolate(requests: DataFrame, knots: DataFrame, x: str, y: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Piecewise-linear ``y`` at each request's ``x``, clamped to the end knots.

    Requests and knots are merged in order; the knot before and the one after
    come from one window pass rather than a range join."""
    tagged = requests.select(*requests.columns, F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__kind"))
    ends = knots.select(*(F.col(c) if c in (*by, x) else F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in requests.columns), F.col(y).cast("double").alias("__y"), F.lit(0).alias("__kind"))
    both = tagged.union(ends).withColumn("__k", F.expr(f"CASE WHEN __kind = 0 THEN struct(CAST({x} AS DOUBLE) AS x, __y AS y) END"))
    order = Window.partitionBy(*by).orderBy(F.col(x), F.col("__kind"))
    both = both.withColumns({"__lo": F.last("__k", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "__hi": F.first("__k", True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    value = f"CASE WHEN __lo IS NULL THEN __hi.y WHEN __hi IS NULL OR __lo.x = {x} THEN __lo.y ELSE __lo.y + (__hi.y - __lo.y) * ({x} - __lo.x) / (__hi.x - __lo.x) END"
    return both.where("__kind = 1").select(*requests.columns, F.expr(value).alias(y))


def match_camera(names: DataFrame, profiles: DataFrame, *, name: str = "name", key: str = "id") -> DataFrame:
    """Each name's first profile, in list order, whose pattern it contains.

    Profiles are a short list (dozens of cameras), names any number."""
    found = names.join(F.broadcast(profiles), F.expr(f"contains(lower({name}), lower(pattern))"))
    return found.groupBy(key).agg(F.expr("min_by(pattern, ord)").alias("pattern"), F.min("ord").alias("ord"))

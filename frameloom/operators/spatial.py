"""Filters and transforms within a frame or block."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.formulas import soft_threshold, to_pixel


def subchannels(clip: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    return clip.selectExpr(*by, "f", "CAST((y % 2) * 2 + x % 2 AS INT) AS comp", "CAST(y DIV 2 AS INT) AS sy", "CAST(x DIV 2 AS INT) AS sx", "v")


def merge_subchannels(grids: DataFrame, value: str = "v", *, by: tuple[str, ...] = ()) -> DataFrame:
    return grids.selectExpr(*by, "f", "CAST(sy * 2 + comp DIV 2 AS INT) AS y", "CAST(sx * 2 + comp % 2 AS INT) AS x", f"{to_pixel(value)} AS v")


def haar(plane: DataFrame, keys: list[str]) -> DataFrame:
    """One level, rows and then columns: ``band`` LL, HL, LH or HH of whole cells."""
    cells = plane.groupBy(*keys, F.expr("CAST(y DIV 2 AS INT)").alias("cy"), F.expr("CAST(x DIV 2 AS INT)").alias("cx")).agg(
        *(F.expr(f"max(CASE WHEN y % 2 = {r} AND x % 2 = {c} THEN v END)").alias(f"v{r}{c}") for r in (0, 1) for c in (0, 1)), F.count("*").alias("k")).where("k = 4")
    bands = {"LL": ("+", "+"), "HL": ("-", "+"), "LH": ("+", "-"), "HH": ("-", "-")}
    row = lambda r, s: f"((v{r}0 {s} v{r}1) / 2D)"
    made = F.array(*(F.struct(F.lit(b).alias("band"), F.expr(f"({row(0, a)} {c} {row(1, a)}) / 2D").alias("v")) for b, (a, c) in bands.items()))
    return cells.select(*keys, F.col("cy").alias("y"), F.col("cx").alias("x"), F.explode(made).alias("b")).select(*keys, "b.band", "y", "x", "b.v")


def inverse_haar(bands: DataFrame, keys: list[str]) -> DataFrame:
    cells = bands.groupBy(*keys, "y", "x").agg(*(F.expr(f"max(CASE WHEN band = '{b}' THEN v END)").alias(b) for b in ("LL", "HL", "LH", "HH")))
    signs = {(0, 0): "LL + HL + LH + HH", (0, 1): "LL - HL + LH - HH", (1, 0): "LL + HL - LH - HH", (1, 1): "LL - HL - LH + HH"}
    made = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.expr(e).alias("v")) for (r, c), e in signs.items()))
    return cells.select(*keys, "y", "x", F.explode(made).alias("p")).selectExpr(*keys, "y * 2 + p.r AS y", "x * 2 + p.c AS x", "p.v")


def mad_sigma(coefficients: DataFrame, keys: list[str], bins: int = 4096) -> DataFrame:
    """Noise from the median absolute value: a histogram scaled to the largest,
    the middle of the bin that reaches half, over 0.6745."""
    mags = coefficients.withColumn("a", F.abs("v"))
    top = mags.groupBy(*keys).agg(F.max("a").alias("top"), F.count("*").alias("n"))
    binned = mags.groupBy(*keys, "a").agg(F.count("*").alias("c")).join(top, keys)
    binned = binned.withColumn("bin", F.expr(f"CASE WHEN top > 0D THEN CAST(least({bins - 1}, floor(a / top * {bins - 1}D)) AS INT) ELSE 0 END"))
    hist = binned.groupBy(*keys, "bin", "top", "n").agg(F.sum("c").alias("c"))
    run = hist.withColumn("run", F.sum("c").over(Window.partitionBy(*keys).orderBy("bin")))
    return run.where("run > n DIV 2").groupBy(*keys).agg(F.expr(f"min_by((bin + 0.5D) * top / {bins - 1}D, bin) / 0.6745D").alias("sigma"))


def bayes_shrink(bands: DataFrame, keys: list[str], noise: float, *, strength: float = 1.0, level: int = 0) -> DataFrame:
    """Soft-thresholds detail bands: noise variance over signal deviation, or
    3 deviations where no signal is left."""
    details = bands.where("band <> 'LL'")
    sigma = mad_sigma(details, [*keys, "band"])
    n = noise * 0.5**level
    t = f"{strength}D * CASE WHEN sigma * sigma > {n * n}D THEN {n * n}D / sqrt(sigma * sigma - {n * n}D) ELSE 3D * sigma END"
    shrunk = details.join(sigma.withColumn("t", F.expr(t)), [*keys, "band"]).select(*keys, "band", "y", "x", F.expr(soft_threshold("v", "t")).alias("v"))
    return shrunk.unionByName(bands.where("band = 'LL'").select(*keys, "band", "y", "x", F.col("v").cast("double").alias("v")))


#: Weights of squared distances 0, 1, 2, 4, 5 and 8 in a 5 x 5 kernel.
KERNEL = {0: 1.0, 1: 0.6065, 2: 0.3679, 4: 0.1353, 5: 0.0821, 8: 0.0183}


def green_bilateral(plane: DataFrame, sigma: float, *, by: tuple[str, ...] = ()) -> DataFrame:
    """5 x 5 bilateral filter of a green plane, its range kernel in 1023 steps of
    the exponent up to 10."""
    keys = [*by, "f"]
    steps = F.array(*(F.struct(F.lit(a).alias("oy"), F.lit(b).alias("ox"), F.lit(KERNEL[a * a + b * b]).alias("k")) for a in range(-2, 3) for b in range(-2, 3)))
    told = plane.select(*keys, "y", "x", "v", F.explode(steps).alias("o")).selectExpr(*keys, "y + o.oy AS y", "x + o.ox AS x", "v AS s", "o.k")
    both = told.join(plane.withColumnRenamed("v", "c"), [*keys, "y", "x"])
    arg = f"(CAST(s AS DOUBLE) - c) * (s - c) / {4 * sigma * sigma}D"
    both = both.withColumn("arg", F.expr(arg)).withColumn("w", F.expr("k * CASE WHEN arg < 10D THEN exp(-floor(arg * 102.3D) / 102.3D) ELSE 0D END"))
    return both.groupBy(*keys, "y", "x").agg(F.expr(to_pixel("sum(w * s) / sum(w)")).alias("v"))


def unsharp(clip: DataFrame, amount: float, sigma: float, height: int, width: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Sharpens against the eight neighbours of a colour, gently below a quarter
    of the noise; two pixels along each border stay."""
    keys = [*by, "f"]
    limit = min(1000.0, max(8.0, sigma * 0.25))
    steps = [(a, b) for a in (-2, 0, 2) for b in (-2, 0, 2) if a or b]
    told = clip.select(*keys, "y", "x", "v", F.explode(F.array(*(F.struct(F.lit(a).alias("oy"), F.lit(b).alias("ox")) for a, b in steps))).alias("o"))
    sums = told.selectExpr(*keys, "y + o.oy AS y", "x + o.ox AS x", "v").where(f"y BETWEEN 2 AND {height - 3} AND x BETWEEN 2 AND {width - 3}").groupBy(*keys, "y", "x").agg(F.expr("CAST(sum(v) DIV 8 AS INT)").alias("avg"))
    both = clip.join(sums, [*keys, "y", "x"], "left").withColumn("d", F.expr("v - avg"))
    gain = f"{amount}D * least(1D, abs(d) / {limit}D)"
    # Truncation towards zero.
    return both.selectExpr(*keys, "y", "x", f"CASE WHEN avg IS NULL THEN v ELSE CAST(least(65535, greatest(0, v + CAST({gain} * d AS INT))) AS INT) END AS v")


def cosine(k: str, i: str, n: int = 8) -> str:
    """Orthonormal DCT-II basis."""
    return f"(CASE WHEN {k} = 0 THEN sqrt(1D / {n}) ELSE sqrt(2D / {n}) END * cos({math.pi}D * {k} * (2D * {i} + 1D) / (2D * {n})))"


def dct(plane: DataFrame, keys: list[str], n: int = 8, *, inverse: bool = False) -> DataFrame:
    """Two-dimensional transform of n x n blocks: rows, then columns; a group
    holds one row or column of a block."""
    out = plane.withColumn("v", F.col("v").cast("double"))
    basis = cosine("i", "k", n) if inverse else cosine("k", "i", n)
    for axis, other in (("x", "y"), ("y", "x")):
        lines = out.groupBy(*keys, other).agg(F.expr(f"transform(array_sort(collect_list(struct({axis}, v))), q -> q.v)").alias("a"))
        lines = lines.withColumn("b", F.expr(f"transform(sequence(0, {n - 1}), k -> aggregate(transform(a, (q, i) -> q * {basis}), 0D, (u, q) -> u + q))"))
        out = lines.select(*keys, other, F.posexplode("b").alias(axis, "v"))
    return out.select(*keys, "y", "x", "v")


def wavelet_26(lines: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Forward 2-6 wavelet along ``i`` of lines of ``n`` values: ``low`` and
    ``high`` of each pair, the high one predicted from the low ones around."""
    pairs = lines.groupBy(*keys, F.expr("CAST(i DIV 2 AS INT)").alias("p")).agg(F.expr("max(CASE WHEN i % 2 = 0 THEN v END)").alias("a"), F.expr("max(CASE WHEN i % 2 = 1 THEN v END)").alias("b"))
    w = Window.partitionBy(*keys).orderBy("p")
    low = pairs.withColumn("low", F.expr("a + b"))
    around = low.withColumns({"before": F.lag("low").over(w), "after": F.lead("low").over(w)})
    for k, e in ((2, "after2"), (-2, "before2")):
        around = around.withColumn(e, F.lead("low", k).over(w) if k > 0 else F.lag("low", -k).over(w))
    inner = "a - b + shiftright(after - before + 4, 3)"
    first = "a - b + shiftright(-3 * low + 4 * after - after2 + 4, 3)"
    last = "a - b + shiftright(3 * low - 4 * before + before2 + 4, 3)"
    edge = f"CASE WHEN before IS NULL AND after2 IS NOT NULL THEN {first} WHEN after IS NULL AND before2 IS NOT NULL THEN {last} WHEN before IS NULL OR after IS NULL THEN a - b ELSE {inner} END"
    clip = lambda e: f"least(32767, greatest(-32768, {e}))"
    return around.selectExpr(*keys, "p", f"{clip('low')} AS low", f"{clip(edge)} AS high")

"""Sliding-window temporal filters over ``f, y, x, v`` clips.

A window of ``w`` frames is centred on a frame and slides to stay inside the
clip at its ends.  ``samples`` gathers the frames around each pixel by a window
over its site, ordered by frame: one exchange by site, which what is grouped by
pixel afterwards shares, and work in proportion to clip length times window.  Every
technique is an aggregation over samples.

Means of whole numbers are rounded to six places before they become pixels, so
that halves don't depend on the order of a sum.

``by`` names further keys, such as a clip id, that all joins and groups include.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions.formulas import clamp, noise_sigma, stabilise, to_pixel, unstabilise

MAX_WINDOW = 16


def window_low(n: int, w: int) -> str:
    """First frame of the window of frame ``f`` in a clip of ``n`` frames."""
    w = min(w, n, MAX_WINDOW)
    return f"least(greatest(f - {w // 2}, 0), {n - w})"


def samples(clip: DataFrame, n: int, w: int, height: int, width: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``f, y, x, c, nf, s, mag`` without motion: a row for each frame of the
    window, the centre itself included.  Sites whose 2 x 2 footprint of one
    colour leaves the frame have the centre alone."""
    from pyspark.sql import Window

    w = min(w, n, MAX_WINDOW)
    # At the ends of the clip a window reaches up to w - 1 frames to one side.
    around = Window.partitionBy(*by, "y", "x").orderBy("f").rangeBetween(1 - w, w - 1)
    held = clip.select(*by, "f", "y", "x", F.col("v").cast("double").alias("c"))
    held = held.withColumn("a", F.collect_list(F.struct(F.col("f").alias("nf"), F.col("c").alias("s"))).over(around)).withColumn("lo", F.expr(window_low(n, w)))
    inside = f"x + 2 < {width} AND y + 2 < {height}"
    near = F.expr(f"inline(filter(a, q -> q.nf = f OR ({inside} AND q.nf BETWEEN lo AND lo + {w - 1})))")
    return held.select(*by, "f", "y", "x", "c", near).withColumn("mag", F.lit(0.0))


def moved_samples(clip: DataFrame, flow: DataFrame, n: int, w: int, height: int, width: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``samples`` along ``flow(f, nf, gy, gx, dx, dy)``, in units of green pixels.

    A neighbour is read between the four nearest sites of its colour; where one
    of them is missing, or a frame has no flow, it is left out."""
    w = min(w, n, MAX_WINDOW)
    keys = list(by)
    centre = clip.select(*keys, "f", "y", "x", F.col("v").cast("double").alias("c"), (F.col("y") / 2).cast("int").alias("gy"), (F.col("x") / 2).cast("int").alias("gx")).withColumn("lo", F.expr(window_low(n, w)))
    aimed = centre.join(flow, [*keys, "f", "gy", "gx"]).where(f"nf <> f AND nf BETWEEN lo AND lo + {w - 1}")
    aimed = aimed.withColumns({"sx": F.expr("x + 2D * dx"), "sy": F.expr("y + 2D * dy")})
    # The nearest lower site of the pixel's own parity.
    aimed = aimed.withColumns({f"{a}0": F.expr(same_parity(f"s{a}", a)) for a in "xy"})
    aimed = aimed.where(f"x0 >= 0 AND x0 + 2 < {width} AND y0 >= 0 AND y0 + 2 < {height}")
    aimed = aimed.withColumns({f"t{a}": F.expr(clamp(f"(s{a} - {a}0) / 2D", "0D", "1D")) for a in "xy"})
    corners = F.array(*(F.struct(F.lit(dy).alias("oy"), F.lit(dx).alias("ox")) for dy in (0, 2) for dx in (0, 2)))
    parts = aimed.select(*keys, "f", "y", "x", "c", "nf", "dx", "dy", "tx", "ty", "y0", "x0", F.explode(corners).alias("o"))
    parts = parts.selectExpr(*keys, "f", "y", "x", "c", "nf", "dx", "dy", "y0 + o.oy AS ny", "x0 + o.ox AS nx", "(CASE o.ox WHEN 0 THEN 1D - tx ELSE tx END) * (CASE o.oy WHEN 0 THEN 1D - ty ELSE ty END) AS part")
    other = clip.select(*keys, F.col("f").alias("nf"), F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("v").alias("nv"))
    read = parts.join(other, [*keys, "nf", "ny", "nx"])
    read = read.groupBy(*keys, "f", "y", "x", "c", "nf", "dx", "dy").agg(F.expr("sum(part * nv)").alias("s"), F.count("*").alias("k")).where("k = 4")
    read = read.selectExpr(*keys, "f", "y", "x", "c", "nf", "s", "sqrt(dx * dx + dy * dy) AS mag")
    own = clip.selectExpr(*keys, "f", "y", "x", "CAST(v AS DOUBLE) AS c", "f AS nf", "CAST(v AS DOUBLE) AS s", "0D AS mag")
    return own.unionByName(read)


def same_parity(s: str, at: str) -> str:
    """The even site at or below ``s``, moved to the parity of ``at``: up if that
    stays at or below the whole part of ``s``, else down."""
    even = f"(CAST(floor({s}) AS INT) - pmod(CAST(floor({s}) AS INT), 2))"
    return f"({even} + CASE WHEN {at} % 2 = 0 THEN 0 WHEN {even} < CAST({s} AS INT) THEN 1 ELSE -1 END)"


def _pixel(by: tuple[str, ...]) -> list[str]:
    return [*by, "f", "y", "x"]


def _out(grouped: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    return grouped.select(*_pixel(by), F.expr(value).alias("v"))


def bilateral(rows: DataFrame, sigma: float, h: float = 1.0, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Range kernel of bandwidth ``h`` on stabilised values; the centre's share
    is at least 0.3, and up to 0.6 where neighbours moved by 3 pixels."""
    s = f"{sigma}D"
    z, zc = stabilise("s", s), stabilise("c", s)
    rows = rows.withColumns({"z": F.expr(z), "zc": F.expr(zc)}).where("nf = f OR abs(z - zc) <= 3D")
    weight = f"exp(-(z - zc) * (z - zc) / (2D * {h}D * {h}D)) * exp(-mag * mag / 8D)"
    grouped = rows.withColumn("w", F.expr(f"CASE WHEN nf = f THEN 0D ELSE {weight} END")).groupBy(*_pixel(by)).agg(
        F.first("c").alias("c"), F.first("zc").alias("zc"), F.sum("w").alias("sw"), F.expr("sum(w * z)").alias("swz"), F.expr("count_if(nf <> f)").alias("k"), F.max("mag").alias("mag"))
    floor = "(0.3D + 0.3D * least(mag / 3D, 1D))"
    scale = f"CASE WHEN sw > 0D AND 1D / (1D + sw) < {floor} THEN (1D - {floor}) / ({floor} * sw) ELSE 1D END"
    mean = "(zc + swz * scale) / (1D + sw * scale)"
    return _out(grouped.withColumn("scale", F.expr(scale)), f"CASE WHEN k = 0 THEN CAST(c AS INT) ELSE {to_pixel(unstabilise(mean, s))} END", by)


def _wiener(rows: DataFrame, sigma: float, by: tuple[str, ...]) -> DataFrame:
    """``z`` (the estimate), ``zc`` and ``c`` of each pixel, and how many samples
    agree with the centre."""
    s = f"{sigma}D"
    rows = rows.withColumns({"z": F.expr(stabilise("s", s)), "zc": F.expr(stabilise("c", s))}).where("abs(z - zc) <= 3D")
    grouped = rows.groupBy(*_pixel(by)).agg(F.first("c").alias("c"), F.first("zc").alias("zc"), F.count("*").alias("k"), F.avg("z").alias("m"), F.expr("avg(z * z) - avg(z) * avg(z)").alias("var"))
    gain = "CASE WHEN var > 0.01D THEN greatest(var - 1D, 0D) / var ELSE 0D END"
    return grouped.withColumn("z", F.expr(f"CASE WHEN k <= 1 THEN zc ELSE m + {gain} * (zc - m) END"))


def wiener(rows: DataFrame, sigma: float, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Shrinks a pixel to the mean of agreeing samples by their excess variance."""
    return _out(_wiener(rows, sigma, by), f"CASE WHEN k <= 1 THEN CAST(c AS INT) ELSE {to_pixel(unstabilise('z', f'{sigma}D'))} END", by)


def inverse_variance(rows: DataFrame, sigma: float, *, by: tuple[str, ...] = ()) -> DataFrame:
    s = f"{sigma}D"
    rows = rows.where(f"abs(s - c) <= 3D * {noise_sigma('c', s)}").withColumn("w", F.expr(f"1D / (pow({noise_sigma('s', s)}, 2) + 1D)"))
    return _out(rows.groupBy(*_pixel(by)).agg(F.expr("round(sum(w * s) / sum(w), 6)").alias("m")), to_pixel("m"), by)


def sigma_clip(rows: DataFrame, sigma: float, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Two rounds of clipping at 2.5 sigma about the mean, then a mean weighted
    by how little samples moved."""
    from pyspark.sql import Window

    limit = f"2.5D * {noise_sigma('c', f'{sigma}D')}"
    pixel = Window.partitionBy(*_pixel(by))
    for _ in range(2):
        rows = rows.withColumn("m", F.avg("s").over(pixel)).withColumn("c0", F.first("c").over(pixel))
        rows = rows.withColumn("keep", F.expr(f"abs(s - m) <= {limit}")).withColumn("any", F.max(F.col("keep").cast("int")).over(pixel))
        # Where nothing survives, one row remains to carry the centre.
        rows = rows.where("keep OR (any = 0 AND nf = f)").withColumn("s", F.expr("CASE WHEN any = 0 THEN c ELSE s END"))
    rows = rows.withColumn("w", F.expr("exp(-mag * mag / 8D)"))
    return _out(rows.groupBy(*_pixel(by)).agg(F.expr("round(sum(w * s) / sum(w), 6)").alias("m")), to_pixel("m"), by)


def dct_shrink(rows: DataFrame, sigma: float, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Hard threshold of temporal cosine coefficients.  Three samples at least;
    samples beyond 3 sigma count as the centre."""
    sig = noise_sigma("c", f"{sigma}D")
    rows = rows.withColumn("s", F.expr(f"CASE WHEN abs(s - c) > 3D * {sig} THEN c ELSE s END"))
    grouped = rows.groupBy(*_pixel(by)).agg(F.first("c").alias("c"), F.expr("array_sort(collect_list(struct(nf, s)))").alias("a")).withColumn("n", F.size("a"))
    grouped = grouped.withColumns({"at": F.expr("array_position(transform(a, q -> q.nf), f) - 1"), "t": F.expr(f"3D * {sig} / sqrt(n)")})
    basis = f"(CASE WHEN k = 0 THEN sqrt(1D / n) ELSE sqrt(2D / n) END * cos({math.pi}D * k * (2D * i + 1D) / (2D * n)))"
    coefficients = f"transform(sequence(0, n - 1), k -> aggregate(transform(a, (q, i) -> q.s * {basis}), 0D, (u, q) -> u + q))"
    grouped = grouped.withColumn("d", F.expr(coefficients))
    back = basis.replace("* i +", "* at +")
    value = f"aggregate(transform(d, (q, k) -> CASE WHEN k > 0 AND abs(q) < t THEN 0D ELSE q * {back} END), 0D, (u, q) -> u + q)"
    return _out(grouped, f"CASE WHEN n < 3 THEN CAST(c AS INT) ELSE {to_pixel(value)} END", by)


def _patches(rows: DataFrame, radius: int, distance: str, by: tuple[str, ...]) -> DataFrame:
    """The neighbours' ``rows`` with ``d2, k``: the mean of ``distance`` over the
    sites of one colour within ``radius`` steps, and how many of them have a sample.

    Box sums in two passes of sliding windows, along rows and then along columns.
    Sites without a sample have sums too, where a sample is within ``radius`` in
    their row, so that columns miss nothing behind a hole."""
    from pyspark.sql import Window

    pair = [*by, "f", "nf"]
    line = Window.partitionBy(*pair, "y", "px").orderBy("sx")
    down = Window.partitionBy(*pair, "x", "py").orderBy("sy").rangeBetween(-radius, radius)
    cells = rows.where("nf <> f").withColumns({"d": F.expr(distance), "sx": F.expr("x DIV 2"), "px": F.expr("x % 2"), "py": F.expr("y % 2")})
    cells = cells.withColumns({"before": F.lag("sx").over(line), "after": F.lead("sx").over(line)})
    own_or_hole = f"q = 0 OR (q > 0 AND (after IS NULL OR sx + q < after)) OR (q < 0 AND (before IS NULL OR sx + q > before + {radius}))"
    cells = cells.withColumn("q", F.explode(F.expr(f"filter(sequence({-radius}, {radius}), q -> {own_or_hole})")))
    cells = cells.withColumns({"d": F.expr("CASE WHEN q = 0 THEN d ELSE 0D END"), "sx": F.expr("sx + q"), "x": F.expr("x + 2 * q")})
    sliding = line.rangeBetween(-radius, radius)
    cells = cells.withColumns({"d": F.sum("d").over(sliding), "k": F.count(F.expr("CASE WHEN q = 0 THEN 1 END")).over(sliding), "sy": F.expr("y DIV 2")})
    cells = cells.withColumns({"d": F.sum("d").over(down), "k": F.sum("k").over(down)})
    return cells.where("q = 0").select(*rows.columns, F.expr("d / k").alias("d2"), "k")


def patch_means(rows: DataFrame, sigma: float, height: int, width: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Non-local means over 5 x 5 patches of stabilised values; two pixels along
    each border stay as they are."""
    s = f"{sigma}D"
    z, zc = stabilise("s", s), stabilise("c", s)
    rows = rows.withColumns({"z": F.expr(z), "zc": F.expr(zc)})
    near = _patches(rows, 2, "(z - zc) * (z - zc)", by).where("k >= 5 AND d2 <= 9D").withColumn("w", F.expr("exp(-d2 / 2D)"))
    sums = near.groupBy(*_pixel(by)).agg(F.sum("w").alias("sw"), F.expr("sum(w * z)").alias("swz"))
    own = rows.where("nf = f").join(sums, _pixel(by), "left").withColumns({"sw": F.expr("coalesce(sw, 0D)"), "swz": F.expr("coalesce(swz, 0D)")})
    inner = f"y BETWEEN 2 AND {height - 3} AND x BETWEEN 2 AND {width - 3}"
    return _out(own, f"CASE WHEN {inner} THEN {to_pixel(unstabilise('(0.4D * zc + swz) / (0.4D + sw)', s))} ELSE CAST(c AS INT) END", by)


def reject_limit(v: str, sigma: str) -> str:
    """Three sigma, the lower of two noise models, in 256 steps of the value."""
    at = f"((shiftright(CAST({v} AS INT), 8) + 0.5D) * (65535D / 256D))"
    return f"least(3D * {noise_sigma(at, sigma)}, 3D * {sigma} * sqrt(1D + {at} / 32768D))"


def baseline(rows: DataFrame, sigma: float, height: int, width: int, *, strength: float = 1.0, chroma: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Non-local means over 3 x 3 patches of raw values without motion."""
    s = f"{sigma}D"
    near = _patches(rows, 1, "(s - c) * (s - c)", by).withColumn("t", F.expr(reject_limit("c", s))).where("sqrt(d2) <= t")
    h = f"({s} * {strength}D * CASE WHEN y % 2 = x % 2 THEN {chroma}D ELSE 1D END * (1D + 0.5D * {clamp('1D - c / 8000D', '0D', '1D')}))"
    dark = "CASE WHEN c < 10000D AND s > c THEN exp(-2D * pow((s - c) / greatest(t, 1D), 2)) ELSE 1D END"
    near = near.withColumn("w", F.expr(f"exp(-d2 / (2D * {h} * {h})) * {dark}"))
    sums = near.groupBy(*_pixel(by)).agg(F.sum("w").alias("sw"), F.expr("sum(w * s)").alias("sws"))
    own = rows.where("nf = f").join(sums, _pixel(by), "left")
    return _out(own, to_pixel("round((c + coalesce(sws, 0D)) / (1D + coalesce(sw, 0D)), 6)"), by)


def guided(rows: DataFrame, sigma: float, epsilon: float = 1.0, radius: int = 4, *, by: tuple[str, ...] = ()) -> DataFrame:
    """The Wiener estimate, guided by the centre: box means over each colour's
    grid, as sliding windows along rows and then along columns."""
    from pyspark.sql import Window

    s = f"{sigma}D"
    grid = _wiener(rows, sigma, by).selectExpr(*_pixel(by), "zc AS g", "z AS p", "y % 2 AS py", "x % 2 AS px", "y DIV 2 AS sy", "x DIV 2 AS sx")
    along = [*by, "f", "py", "px"]
    across = Window.partitionBy(*along, "sy").orderBy("sx").rangeBetween(-radius, radius)
    down = Window.partitionBy(*along, "sx").orderBy("sy").rangeBetween(-radius, radius)

    def box(df: DataFrame, sums: dict[str, str]) -> DataFrame:
        df = df.withColumns({f"{k}_row": F.sum(F.expr(e)).over(across) for k, e in sums.items()})
        return df.withColumns({k: F.sum(f"{k}_row").over(down) for k in sums})

    grid = box(grid, {"n": "1D", "sg": "g", "sp": "p", "sgg": "g * g", "sgp": "g * p"})
    slope = f"(sgp / n - sg / n * sp / n) / (sgg / n - sg / n * sg / n + {epsilon}D)"
    grid = grid.withColumn("a", F.expr(slope)).withColumn("b", F.expr("sp / n - a * sg / n"))
    grid = box(grid, {"sa": "a", "sb": "b"})
    return _out(grid, to_pixel(unstabilise("(sa / n * g + sb / n)", s)), by)


#: Techniques by name: each takes samples, the noise, height and width.
TECHNIQUES = {
    "nlm_baseline": lambda r, s, h, w, by=(): baseline(r, s, h, w, by=by),
    "vst_wiener": lambda r, s, h, w, by=(): wiener(r, s, by=by),
    "inv_variance": lambda r, s, h, w, by=(): inverse_variance(r, s, by=by),
    "vst_nlm": lambda r, s, h, w, by=(): patch_means(r, s, h, w, by=by),
    "dct_shrink": lambda r, s, h, w, by=(): dct_shrink(r, s, by=by),
    "sigma_clip": lambda r, s, h, w, by=(): sigma_clip(r, s, by=by),
    "vst_guided": lambda r, s, h, w, by=(): guided(r, s, 1.0, by=by),
    "vst_bilateral": lambda r, s, h, w, by=(): bilateral(r, s, 1.0, by=by),
    "vst_guided_tight": lambda r, s, h, w, by=(): guided(r, s, 0.1, by=by),
    "vst_guided_mid": lambda r, s, h, w, by=(): guided(r, s, 0.3, by=by),
    "vst_bilateral_tight": lambda r, s, h, w, by=(): bilateral(r, s, 0.8, by=by),
    "vst_bilateral_wide": lambda r, s, h, w, by=(): bilateral(r, s, 1.2, by=by),
}


def sweep(rows: DataFrame, sigma: float, height: int, width: int, names: list[str] | None = None) -> DataFrame:
    """All techniques over the same samples, as one long table."""
    made = [TECHNIQUES[t](rows, sigma, height, width).withColumn("technique", F.lit(t)) for t in names or TECHNIQUES]
    return reduce(DataFrame.unionByName, made)


def far_flow(flow: DataFrame, reach: int = 2, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Flow to frames beyond ``reach``: the flow to the farthest within it on the
    same side, in proportion to the distance.  ``flow`` has a row for each frame
    wanted; those beyond reach have their motion replaced, zero if none is near."""
    keys = [*by, "f", "gy", "gx", "side"]
    flow = flow.withColumns({"side": F.expr("CAST(sign(nf - f) AS INT)"), "far": F.expr("abs(nf - f)")})
    near = flow.where(f"far BETWEEN 1 AND {reach}").groupBy(*keys).agg(F.expr("max_by(struct(dx, dy, far), far)").alias("m"))
    scaled = flow.join(near, keys, "left")
    for a in ("dx", "dy"):
        scaled = scaled.withColumn(a, F.expr(f"CASE WHEN far <= {reach} THEN {a} ELSE coalesce(m.{a} * far / m.far, 0D) END"))
    return scaled.select(*by, "f", "nf", "gy", "gx", "dx", "dy")


def nearest_neighbours(frames: DataFrame, cap: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Of ``f, nf`` the ``cap`` nearest for each ``f``, the earlier first."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by, "f").orderBy(F.abs(F.col("nf") - F.col("f")), "nf")
    return frames.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def smoothed_flow(motion: DataFrame, start: float = 2.0, rate: float = 0.1, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``f, s``: exponential smoothing of ``f, avg`` over consecutive frames from
    0, in closed form: a running sum of the terms over powers of ``1 - rate``,
    restarted in blocks of 256 frames so that the powers stay in range."""
    from pyspark.sql import Window

    size, keep = 256, 1 - rate
    block = Window.partitionBy(*by, "block").orderBy("f")
    rows = motion.withColumns({"block": F.expr(f"f DIV {size}"), "i": F.expr(f"f % {size}")})
    rows = rows.withColumn("own", F.expr(f"pow({keep}D, i)") * F.sum(F.expr(f"{rate}D * avg / pow({keep}D, i)")).over(block))
    last = rows.groupBy(*by, "block").agg(F.max_by("own", "i").alias("gain"), (F.max("i") + 1).alias("n"))
    # What is further back than this has no weight that a double can hold.
    reach = math.ceil(745 / (size * -math.log(keep)))
    chain = Window.partitionBy(*by).orderBy("block").rowsBetween(-reach, -1)
    ends = last.withColumn("all", F.collect_list(F.struct("gain", "n")).over(chain))
    ends = ends.withColumn("before", F.expr(f"aggregate(all, {start}D, (s, e) -> s * pow({keep}D, e.n) + e.gain)")).select(*by, "block", "before")
    return rows.join(ends, [*by, "block"]).select(*by, "f", F.expr(f"before * pow({keep}D, i + 1) + own").alias("s"))

"""Noise estimates, dark frames and hot pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def green_pairs(clip: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``f, cy, cx, gr, gb``: both greens of every 2 x 2 cell, in one aggregation."""
    cells = clip.where("(y % 2) <> (x % 2)").selectExpr(*by, "f", "y DIV 2 AS cy", "x DIV 2 AS cx", "y % 2 AS row", "v")
    return cells.groupBy(*by, "f", "cy", "cx").agg(F.expr("max(CASE WHEN row = 0 THEN v END)").alias("gr"), F.expr("max(CASE WHEN row = 1 THEN v END)").alias("gb")).where("gr IS NOT NULL AND gb IS NOT NULL")


def frame_noise(clip: DataFrame, *, tile: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Standard deviation of one green from the differences of the two; 0 for
    less than two cells.  ``tile`` estimates each square of that many pixels."""
    pairs = green_pairs(clip, by=by)
    keys = [*by, "f"]
    if tile:
        pairs = pairs.withColumns({"ty": F.expr(f"CAST(cy * 2 DIV {tile} AS INT)"), "tx": F.expr(f"CAST(cx * 2 DIV {tile} AS INT)")})
        keys += ["ty", "tx"]
    return pairs.groupBy(*keys).agg(F.expr("CASE WHEN count(*) < 2 THEN 0D ELSE sqrt(var_pop(gr - gb) / 2D) END").alias("sigma"))


def patch_profile(frame: DataFrame, px: int, py: int, pw: int, ph: int, height: int, width: int, block: int = 16) -> DataFrame:
    """One row: the noise model of a flat patch of one frame.

    ``sigma`` and ``mean_signal`` come from the greens; ``black_level`` is the
    5 % order statistic of block means, ``read_noise`` and ``shot_gain`` the fit
    of block variances against means above it.  Patches under 32 x 32 pixels
    after alignment, or with under 16 pairs, aren't valid.
    """
    if px < 0:
        pw, px = pw + px, 0
    if py < 0:
        ph, py = ph + py, 0
    pw, ph = min(pw, width - px), min(ph, height - py)
    if px % 2:
        px, pw = px + 1, pw - 1
    if py % 2:
        py, ph = py + 1, ph - 1
    names = ["sigma", "read_noise", "shot_gain", "black_level", "mean_signal", "valid"]
    if pw < 32 or ph < 32:
        return frame.sparkSession.range(1).selectExpr(*(f"0D AS {c}" for c in names[:-1]), "false AS valid")
    # The last green of a row is left out, as its pair isn't looked for.
    pairs = green_pairs(frame.where(f"y >= {py} AND y < {py + ph - ph % 2} AND x >= {px} AND x < {px + pw - pw % 2}")).where(f"cx * 2 + 2 < {px + pw}")
    whole = pairs.agg(F.count("*").alias("pairs"), F.expr("var_pop(gr - gb)").alias("vd"), F.expr("avg((gr + gb) * 0.5D)").alias("mean_signal"))
    greens = frame.where(f"y % 2 = 0 AND x % 2 = 1 AND y >= {py} AND x >= {px} AND y < {py + ph // block * block} AND x < {px + pw // block * block}")
    cells = greens.groupBy(F.expr(f"(y - {py}) DIV {block}").alias("by"), F.expr(f"(x - {px}) DIV {block}").alias("bx")).agg(F.avg("v").alias("m"), F.expr("var_pop(v)").alias("s2"))
    # Blocks of one patch: few, so that one row may hold their means.
    ordered = cells.agg(F.array_sort(F.collect_list("m")).alias("ms"), F.count("*").alias("n"))
    ordered = ordered.selectExpr("n", "element_at(ms, CAST(n DIV 20 + 1 AS INT)) AS bl")
    x = cells.crossJoin(F.broadcast(ordered)).withColumn("u", F.expr("greatest(m - bl, 0D)"))
    fit = x.agg(F.max("n").alias("n"), F.max("bl").alias("bl"), F.sum("u").alias("sx"), F.sum("s2").alias("sy"), F.expr("sum(u * u)").alias("sxx"), F.expr("sum(u * s2)").alias("sxy"))
    both = whole.crossJoin(F.broadcast(fit)).withColumn("d", F.expr("n * sxx - sx * sx"))
    both = both.withColumns({
        "few": F.expr("coalesce(n, 0) < 4"),
        "a": F.expr("greatest(CASE WHEN abs(d) < 1e-6D THEN sy / n ELSE (sy * sxx - sx * sxy) / d END, 0D)"),
        "b": F.expr("greatest(CASE WHEN abs(d) < 1e-6D THEN 0D ELSE (n * sxy - sx * sy) / d END, 0D)"),
        "flat": F.expr("sqrt(vd / 2D)"),
    })
    both = both.withColumn("at_mean", F.expr("a + b * greatest(mean_signal - bl, 0D)"))
    ok = "pairs >= 16"
    values = {
        "sigma": "CASE WHEN few OR at_mean <= 0D THEN flat ELSE sqrt(at_mean) END",
        "read_noise": "CASE WHEN few THEN flat ELSE sqrt(a) END",
        "shot_gain": "CASE WHEN few THEN 0D ELSE b END",
        "black_level": "CASE WHEN few THEN 0D ELSE bl END",
        "mean_signal": "mean_signal",
    }
    return both.select(*(F.expr(f"CASE WHEN {ok} THEN {e} ELSE 0D END").alias(c) for c, e in values.items()), F.expr(ok).alias("valid"))


def dark_master(clip: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Truncated mean of every site over the frames of a dark clip."""
    return clip.groupBy(*by, "y", "x").agg(F.expr("CAST(sum(v) DIV count(v) AS INT)").alias("v"))


def dark_subtract(clip: DataFrame, dark: DataFrame, floor: int = 16, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Values less the dark ones, ``floor`` at least; sites without dark value
    have 0.  A dark map is a frame: a small fraction of any clip."""
    sites = dark.withColumnRenamed("v", "d")
    joined = clip.join(sites, [*by, "y", "x"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    return joined.selectExpr(*by, "f", "y", "x", f"CASE WHEN v > d + {floor} THEN v - d ELSE {floor} END AS v")


def sampled_frames(n: int, most: int) -> tuple[int, int]:
    """Step and number of evenly spaced frames of ``n``."""
    count = max(1, min(most, n))
    return max(1, n // count), count


def neighbourhood(sites: DataFrame, height: int, width: int, keys: list[str], *, itself: bool) -> DataFrame:
    """Each site's values around it in its own colour, as ``near`` (sorted)."""
    steps = [(dy, dx) for dy in (-2, 0, 2) for dx in (-2, 0, 2) if itself or dy or dx]
    told = sites.select(*keys, "y", "x", "v", F.explode(F.array(*(F.struct(F.lit(a).alias("oy"), F.lit(b).alias("ox")) for a, b in steps))).alias("o"))
    told = told.selectExpr(*keys, "y + o.oy AS y", "x + o.ox AS x", "v").where(f"y BETWEEN 0 AND {height - 1} AND x BETWEEN 0 AND {width - 1}")
    return told.groupBy(*keys, "y", "x").agg(F.array_sort(F.collect_list("v")).alias("near"))


def auto_dark(clip: DataFrame, n: int, height: int, width: int, most: int = 30, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Excess of sites whose least value over sampled frames stands out from
    their neighbourhood's upper median; 0 elsewhere."""
    step, count = sampled_frames(n, most)
    lows = clip.where(f"f % {step} = 0 AND f DIV {step} < {count}").groupBy(*by, "y", "x").agg(F.min("v").alias("v"))
    near = neighbourhood(lows, height, width, list(by), itself=True).selectExpr(*by, "y", "x", "element_at(near, CAST(size(near) DIV 2 + 1 AS INT)) AS med")
    hot = "v > med + 200 AND v > 3 * med AND v > 500"
    return lows.join(near, [*by, "y", "x"]).selectExpr(*by, "y", "x", f"CASE WHEN {hot} THEN v - med ELSE 0 END AS v")


def repair_hot(clip: DataFrame, hot: DataFrame, height: int, width: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Listed sites get the median of their neighbours in the input (of an even
    number, the truncated mean of the middle two); others stay."""
    keys = [*by, "f"]
    sites = hot.select("y", "x").distinct()
    steps = [(dy, dx) for dy in (-2, 0, 2) for dx in (-2, 0, 2) if dy or dx]
    around = sites.select("y", "x", F.explode(F.array(*(F.struct(F.lit(a).alias("oy"), F.lit(b).alias("ox")) for a, b in steps))).alias("o"))
    around = around.selectExpr("y AS hy", "x AS hx", "y + o.oy AS y", "x + o.ox AS x").where(f"y BETWEEN 0 AND {height - 1} AND x BETWEEN 0 AND {width - 1}")
    near = clip.join(around, ["y", "x"]).groupBy(*keys, F.col("hy").alias("y"), F.col("hx").alias("x")).agg(F.array_sort(F.collect_list("v")).alias("a")).withColumn("k", F.size("a"))
    median = "CASE WHEN k % 2 = 1 THEN element_at(a, CAST(k DIV 2 + 1 AS INT)) ELSE CAST((element_at(a, CAST(k DIV 2 AS INT)) + element_at(a, CAST(k DIV 2 + 1 AS INT))) DIV 2 AS INT) END"
    fixed = near.select(*keys, "y", "x", F.expr(median).alias("m"))
    return clip.join(fixed, [*keys, "y", "x"], "left").select(*keys, "y", "x", F.coalesce("m", "v").alias("v"))


def nearest_profile(profiles: DataFrame, iso: int, order: str = "ord") -> DataFrame:
    """All rows of the listed ISO that is nearest; ties go to the first listed."""
    first = profiles.orderBy(F.abs(F.col("iso") - iso), order).select("iso").limit(1)
    return profiles.join(F.broadcast(first), "iso", "left_semi")

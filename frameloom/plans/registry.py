"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions import formulas as fm
from frameloom.operators import calibration as cal
from frameloom.operators import colour as col
from frameloom.operators import motion as mo
from frameloom.operators import spatial as sp
from frameloom.operators import temporal as tm
from frameloom.operators import video as vi

from . import adapters as ad
from .oracle import EMB, PX, PX32, RGB, SAMPLES, SG, back, duck, px_of, samples, sig, z

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# Adapters and projections ----------------------------------------------------------

query("px_frames", PX.replace("n AS (", "WITH n AS (", 1).replace(", n WHERE event_id // 256 < n.n", "") + " SELECT f, count(*) AS pixels, sum(v)::BIGINT AS total FROM px GROUP BY f")(
    lambda s, d: ad.pixels(s, d, complete=False).groupBy("f").agg(F.count("*").alias("pixels"), F.sum("v").alias("total"))
)
query("px_complete", f"WITH {PX} SELECT f, y, x, v FROM px")(lambda s, d: ad.pixels(s, d))
query("emb_blocks", f"WITH {EMB} SELECT id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v FROM emb")(lambda s, d: ad.blocks(s, d))


def _scalar(name: str, **columns: str) -> None:
    """A projection of the clip's pixels, one text for both engines."""
    out = ", ".join(f"{duck(e)} AS {c}" for c, e in columns.items())
    query(name, f"WITH {PX} SELECT f, y, x, {out} FROM px")(lambda s, d: ad.pixels(s, d).selectExpr("f", "y", "x", *(f"{e} AS {c}" for c, e in columns.items())))


_scalar("noise_sigma_model", sigma=f"round({fm.noise_sigma('v', SG)}, 6)")
_scalar("anscombe_fwd", z=f"round({fm.stabilise('v', SG)}, 6)")
_scalar("anscombe_roundtrip", v=fm.to_pixel(fm.unstabilise(fm.stabilise("v", SG), SG)))
_scalar("bit_shift", b12="shiftright(v, 4)", b10="shiftright(v, 6)", back="shiftright(v, 4) * 16")
_scalar("sign_fold", folded=fm.fold_sign("(v - 6032)"), same=f"CAST({fm.fold_sign('(v - 6032)')} % 2 = CASE WHEN v < 6032 THEN 1 ELSE 0 END AS INT)")
_scalar("compand", expanded=f"CAST({fm.compand('CAST(v % 256 AS BIGINT)')} AS BIGINT)")
_scalar("quant_half_away", q=fm.half_away("(v - 6032)", "37").replace("37 DIV 2", "18").replace("/ 37", "/ 37D"))
_scalar("quant_dead_zone", q=fm.dead_zone("(v - 6032)", "37"))
_scalar("quant_reciprocal", q="CAST(sign(v - 6032) * floor(abs(v - 6032) * 886D / 32768D) AS INT)", back="shiftright((v - 6032) * 37 + 32768, 16)")
_scalar("soft_threshold", t=f"round({fm.soft_threshold('(v - 6032)', '616D')}, 6)")
_scalar("half_float_scale", share="round(v / 65535D, 6)")
_scalar("residual_blend", v="CAST(floor(least(1D, greatest(0D, v / 65535D - 0.4D * (v % 17) / 1000D)) * 65535D + 0.5D) AS INT)")
_scalar("motion_presets", window=mo.window_for("(v / 10000D)"), hint="CASE WHEN v / 10000D < 1D THEN 'static' WHEN v / 10000D < 3D THEN 'slow' ELSE 'fast' END")
query("luma_bt709", f"WITH {RGB} SELECT f, y, x, {duck(fm.luma('r', 'g', 'b'))} AS v FROM rgb")(lambda s, d: col.luma_of(ad.colour(s, d)))
query(
    "preview_rgb",
    f"""WITH {PX} SELECT f, y // 2 AS y, x // 2 AS x, max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v END) >> 8 AS r,
        CAST(sum(CASE WHEN y % 2 <> x % 2 THEN v END) // 2 AS INT) >> 8 AS g, max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v END) >> 8 AS b
        FROM px GROUP BY f, y // 2, x // 2""",
)(lambda s, d: col.preview(ad.pixels(s, d)))
query("subchannel_split", f"WITH {PX} SELECT f, (y % 2) * 2 + x % 2 AS comp, y // 2 AS sy, x // 2 AS sx, v FROM px")(lambda s, d: sp.subchannels(ad.pixels(s, d)))
query("subchannel_merge", f"WITH {PX} SELECT f, y, x, v FROM px")(lambda s, d: sp.merge_subchannels(sp.subchannels(ad.pixels(s, d))))
for _name, (_dy, _dx) in {"grbg": (0, 1), "gbrg": (1, 0), "bggr": (1, 1)}.items():
    query(
        f"cfa_remap_{_name}",
        f"WITH {PX} SELECT a.f, a.y, a.x, coalesce(b.v, 0) AS v FROM px a LEFT JOIN px b ON b.f = a.f AND b.y = a.y + {_dy} AND b.x = a.x + {_dx}",
    )(lambda s, d, dy=_dy, dx=_dx: remap(ad.pixels(s, d), dy, dx))
query("cfa_roundtrip", f"WITH {PX} SELECT f, y, x, CASE WHEN y < 1 OR x < 1 THEN 0 ELSE v END AS v FROM px")(lambda s, d: remap(remap(ad.pixels(s, d), 1, 1), -1, -1))
query(
    "timing_map",
    "SELECT p_partkey AS id, CASE p_size % 7 WHEN 0 THEN 24000 WHEN 1 THEN 24 WHEN 2 THEN 120 WHEN 3 THEN 30000 WHEN 4 THEN 48000 WHEN 5 THEN 47 ELSE 90000 END AS scale, "
    "CASE p_size % 7 WHEN 0 THEN 1001 WHEN 3 THEN 1001 WHEN 4 THEN 1001 WHEN 6 THEN 7200 ELSE 1 END AS duration FROM part",
)(
    lambda s, d: ad.table(s, d, "part")
    .selectExpr("p_partkey AS id", "element_at(array(24000D/1001, 24D, 120D, 30000D/1001, 47.952D, 47D, 12.5D), CAST(p_size % 7 + 1 AS INT)) AS fps")
    .selectExpr("id", *timing("fps"))
)


def remap(clip: DataFrame, dy: int, dx: int) -> DataFrame:
    """Shifts a mosaic's phase; sites that nothing moves to are 0."""
    moved = clip.selectExpr("f", f"y - ({dy}) AS y", f"x - ({dx}) AS x", "v AS moved")
    return clip.join(moved, ["f", "y", "x"], "left").selectExpr("f", "y", "x", "coalesce(moved, 0) AS v")


def timing(fps: str) -> list[str]:
    """Ticks a second and a frame: 1000/1001 of a usual rate, a whole rate as it is,
    else 90000 ticks a second."""
    slowed = " ".join(f"WHEN abs({fps} - {rate * 1000}D / 1001) < 0.01D THEN {{{i}}}" for i, rate in enumerate((24, 30, 48, 60)))
    whole = f"abs({fps} - floor({fps} + 0.5D)) < 0.01D"
    scale = "CASE " + slowed.format(24000, 30000, 48000, 60000) + f" WHEN {whole} THEN CAST(floor({fps} + 0.5D) AS INT) ELSE 90000 END"
    step = "CASE " + slowed.format(*[1001] * 4) + f" WHEN {whole} THEN 1 ELSE CAST(floor(90000D / {fps} + 0.5D) AS INT) END"
    return [f"{scale} AS scale", f"{step} AS duration"]


# Filters, noise and calibration -----------------------------------------------------

query("trim_range", f"WITH {PX} SELECT f, y, x, v FROM px WHERE f >= 1 AND f < 3")(lambda s, d: ad.pixels(s, d).where("f >= 1 AND f < 3"))
query("sampled_frames", f"WITH {PX} SELECT f, count(*) AS pixels FROM px, n WHERE f % greatest(1, n.n // least(30, n.n)) = 0 AND f // greatest(1, n.n // least(30, n.n)) < least(30, n.n) GROUP BY f")(
    lambda s, d: (lambda step, k: ad.pixels(s, d).where(f"f % {step} = 0 AND f DIV {step} < {k}").groupBy("f").agg(F.count("*").alias("pixels")))(*cal.sampled_frames(ad.frame_count(s, d), 30))
)
query("frame_noise", f"WITH {PX}, g AS (SELECT f, y // 2 AS cy, x // 2 AS cx, max(CASE WHEN y % 2 = 0 THEN v END) - max(CASE WHEN y % 2 = 1 THEN v END) AS d FROM px WHERE y % 2 <> x % 2 GROUP BY ALL) SELECT f, round(sqrt(var_pop(d) / 2), 6) AS sigma FROM g GROUP BY f")(
    lambda s, d: cal.frame_noise(ad.pixels(s, d)).withColumn("sigma", F.round("sigma", 6))
)
query("tile_noise", f"WITH {PX}, g AS (SELECT f, y // 2 AS cy, x // 2 AS cx, max(CASE WHEN y % 2 = 0 THEN v END) - max(CASE WHEN y % 2 = 1 THEN v END) AS d FROM px WHERE y % 2 <> x % 2 GROUP BY ALL) SELECT f, cy // 4 AS ty, cx // 4 AS tx, round(sqrt(var_pop(d) / 2), 6) AS sigma FROM g GROUP BY ALL")(
    lambda s, d: cal.frame_noise(ad.pixels(s, d), tile=8).withColumn("sigma", F.round("sigma", 6))
)
query(
    "patch_profile",
    f"""WITH {PX32}, fr AS (SELECT y, x, v FROM px WHERE f = 0),
    g AS (SELECT a.v AS gr, b.v AS gb FROM fr a JOIN fr b ON b.y = a.y + 1 AND b.x = a.x - 1 WHERE a.y % 2 = 0 AND a.x % 2 = 1 AND a.x + 1 < 32),
    t AS (SELECT count(*) AS pairs, var_pop(gr - gb) AS vd, avg((gr + gb) * 0.5) AS ms FROM g),
    c AS (SELECT avg(v) AS m, var_pop(v) AS s2 FROM fr WHERE y % 2 = 0 AND x % 2 = 1 GROUP BY y // 16, x // 16),
    b AS (SELECT count(*) AS n, min(m) AS bl FROM c), u AS (SELECT greatest(m - bl, 0) AS u, s2, n, bl FROM c, b),
    q AS (SELECT max(n) AS n, max(bl) AS bl, sum(u) AS sx, sum(s2) AS sy, sum(u * u) AS sxx, sum(u * s2) AS sxy FROM u),
    r AS (SELECT *, n * sxx - sx * sx AS d FROM q),
    k AS (SELECT *, greatest(CASE WHEN abs(d) < 1e-6 THEN sy / n ELSE (sy * sxx - sx * sxy) / d END, 0) AS a, greatest(CASE WHEN abs(d) < 1e-6 THEN 0 ELSE (n * sxy - sx * sy) / d END, 0) AS b FROM r)
    SELECT round(CASE WHEN n < 4 OR a + b * greatest(ms - bl, 0) <= 0 THEN sqrt(vd / 2) ELSE sqrt(a + b * greatest(ms - bl, 0)) END, 6) AS sigma, round(CASE WHEN n < 4 THEN sqrt(vd / 2) ELSE sqrt(a) END, 6) AS read_noise,
           round(CASE WHEN n < 4 THEN 0 ELSE b END, 6) AS shot_gain, round(CASE WHEN n < 4 THEN 0 ELSE bl END, 6) AS black_level, round(ms, 6) AS mean_signal, pairs >= 16 AS valid FROM t, k""",
)(lambda s, d: rounded(cal.patch_profile(ad.pixels(s, d, 32).where("f = 0"), 0, 0, 32, 32, 32, 32), ["sigma", "read_noise", "shot_gain", "black_level", "mean_signal"]))


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


_DARK = "d AS (SELECT y, x, CAST(sum(v) // count(v) AS INT) AS d FROM px GROUP BY y, x)"
query("dark_master", f"WITH {PX}, {_DARK} SELECT y, x, d AS v FROM d")(lambda s, d: cal.dark_master(ad.pixels(s, d)))
query("dark_subtract", f"WITH {PX}, {_DARK} SELECT f, px.y, px.x, CASE WHEN v > d + 16 THEN v - d ELSE 16 END AS v FROM px JOIN d USING (y, x)")(
    lambda s, d: cal.dark_subtract(ad.pixels(s, d), cal.dark_master(ad.pixels(s, d)))
)
_AROUND = "o AS (SELECT a.y * 2 AS oy, b.x * 2 AS ox FROM (SELECT unnest([-1, 0, 1]) AS y) a, (SELECT unnest([-1, 0, 1]) AS x) b)"
query(
    "auto_dark_map",
    f"""WITH {PX}, lows AS (SELECT y, x, min(v) AS v FROM px, n WHERE f % greatest(1, n.n // least(30, n.n)) = 0 AND f // greatest(1, n.n // least(30, n.n)) < least(30, n.n) GROUP BY y, x), {_AROUND},
    m AS (SELECT a.y, a.x, list_sort(list(b.v))[count(*) // 2 + 1] AS med FROM lows a, o, lows b WHERE b.y = a.y + oy AND b.x = a.x + ox GROUP BY a.y, a.x)
    SELECT y, x, CASE WHEN v > med + 200 AND v > 3 * med AND v > 500 THEN v - med ELSE 0 END AS v FROM lows JOIN m USING (y, x)""",
)(lambda s, d: cal.auto_dark(ad.pixels(s, d), ad.frame_count(s, d), 16, 16))
query(
    "hot_predicate",
    f"""WITH {PX}, {_AROUND}, m AS (SELECT a.f, a.y, a.x, a.v, list_sort(list(b.v))[count(*) // 2 + 1] AS med FROM px a, o, px b WHERE b.f = a.f AND b.y = a.y + oy AND b.x = a.x + ox GROUP BY ALL)
    SELECT f, y, x, v, med FROM m WHERE v > med + 200 AND v > 3 * med AND v > 500""",
)(lambda s, d: (lambda px: px.join(cal.neighbourhood(px, 16, 16, ["f"], itself=True).selectExpr("f", "y", "x", "element_at(near, CAST(size(near) DIV 2 + 1 AS INT)) AS med"), ["f", "y", "x"]).where("v > med + 200 AND v > 3 * med AND v > 500"))(ad.pixels(s, d)))
query(
    "hot_repair",
    f"""WITH {PX}, {_AROUND}, h AS (SELECT CAST(event_id // 16 AS INT) AS y, CAST(event_id % 16 AS INT) AS x FROM events WHERE event_id < 256 AND event_id % 37 = 0),
    m AS (SELECT b.f, h.y, h.x, list_sort(list(b.v)) AS a, count(*) AS k FROM h, o, px b WHERE (oy <> 0 OR ox <> 0) AND b.y = h.y + oy AND b.x = h.x + ox GROUP BY b.f, h.y, h.x)
    SELECT px.f, px.y, px.x, coalesce(CASE WHEN k % 2 = 1 THEN a[k // 2 + 1] ELSE (a[k // 2] + a[k // 2 + 1]) // 2 END, v) AS v FROM px LEFT JOIN m USING (f, y, x)""",
)(lambda s, d: cal.repair_hot(ad.pixels(s, d), ad.hot_list(s, d), 16, 16))
query("nearest_iso", "SELECT p_partkey AS ord, lower(p_brand) AS pattern, 100 * p_size AS iso, round(p_retailprice / 1000, 6) AS sigma FROM part WHERE 100 * p_size = (SELECT 100 * p_size FROM part ORDER BY abs(100 * p_size - 1234), p_partkey LIMIT 1)")(
    lambda s, d: rounded(cal.nearest_profile(ad.iso_table(s, d), 1234), ["sigma"]).select("ord", "pattern", "iso", "sigma")
)

# Joins ---------------------------------------------------------------------------------

_GREEN = "g AS (SELECT f, y // 2 AS y, x // 2 AS x, CAST(sum(v) // 2 AS INT) AS v FROM px WHERE y % 2 <> x % 2 GROUP BY f, y // 2, x // 2)"
query("green_extract", f"WITH {PX}, {_GREEN} SELECT * FROM g")(lambda s, d: mo.green_plane(ad.pixels(s, d)))
query(
    "iso_interp",
    """WITH k AS (SELECT 100 * p_size AS iso, min(p_retailprice / 1000) AS sigma FROM part WHERE p_size % 5 = 0 GROUP BY p_size),
    r AS (SELECT DISTINCT 100 * p_size AS iso FROM part), b AS (SELECT r.iso, (SELECT max(k.iso) FROM k WHERE k.iso <= r.iso) AS lo, (SELECT min(k.iso) FROM k WHERE k.iso >= r.iso) AS hi FROM r)
    SELECT b.iso, round(CASE WHEN lo IS NULL THEN h.sigma WHEN hi IS NULL OR lo = hi THEN l.sigma ELSE l.sigma + (h.sigma - l.sigma) * (b.iso - lo) / (hi - lo) END, 6) AS sigma
    FROM b LEFT JOIN k l ON l.iso = lo LEFT JOIN k h ON h.iso = hi""",
)(lambda s, d: (lambda t: rounded(col.interpolate(t.select("iso").distinct(), t.where("iso % 500 = 0").groupBy("iso").agg(F.min("sigma").alias("sigma")), "iso", "sigma"), ["sigma"]))(ad.iso_table(s, d)))
query(
    "camera_match",
    """WITH p AS (SELECT min(p_partkey) AS ord, lower(split_part(p_name, ' ', 1)) AS pattern FROM part GROUP BY ALL),
    m AS (SELECT q.p_partkey AS id, p.pattern, p.ord, row_number() OVER (PARTITION BY q.p_partkey ORDER BY p.ord) AS rn FROM part q JOIN p ON contains(lower(q.p_name), p.pattern))
    SELECT id, pattern, ord FROM m WHERE rn = 1""",
)(lambda s, d: (lambda t: col.match_camera(t.selectExpr("p_partkey AS id", "p_name AS name"), t.groupBy(F.expr("lower(split_part(p_name, ' ', 1))").alias("pattern")).agg(F.min("p_partkey").alias("ord"))))(ad.table(s, d, "part")))
query("new_files_anti", "SELECT o_orderkey AS id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 25)")(
    lambda s, d: ad.table(s, d, "orders").selectExpr("o_orderkey AS id").join(ad.table(s, d, "lineitem").where("l_quantity > 25").selectExpr("l_orderkey AS id"), "id", "left_anti")
)
query("lut1d_apply", f"WITH {PX}, p AS (SELECT *, v / 65535.0::DOUBLE * 16 AS p FROM px), i AS (SELECT *, least(CAST(floor(p) AS INT), 15) AS i FROM p) SELECT f, y, x, CAST(floor(least(65535, greatest(0, ((i / 16.0::DOUBLE) ** 2 + (((i + 1) / 16.0::DOUBLE) ** 2 - (i / 16.0::DOUBLE) ** 2) * (p - i)) * 65535)) + 0.5) AS INT) AS v FROM i")(
    lambda s, d: col.lut1d(ad.pixels(s, d), s.range(17).selectExpr("CAST(id AS INT) AS idx", "pow(id / 16D, 2) AS v"), 17)
)

def _lut_sql() -> str:
    def value(channel: str) -> str:
        terms = []
        for dr in (0, 1):
            for dg in (0, 1):
                for db in (0, 1):
                    w = " * ".join(f"t{c}" if b else f"(1 - t{c})" for c, b in zip("rgb", (dr, dg, db)))
                    r, g, b = f"((r0 + {dr}) / 4.0::DOUBLE)", f"((g0 + {dg}) / 4.0::DOUBLE)", f"((b0 + {db}) / 4.0::DOUBLE)"
                    e = {"r": f"({r} * {g})", "g": f"({g} * {g})", "b": f"(0.5 * {b} + 0.5 * {r} * {b})"}[channel]
                    terms.append(f"{w} * {e}")
        return " + ".join(terms)

    pos = ", ".join(f"{c} / 65535.0::DOUBLE * 4 AS p{c}, least(CAST(floor({c} / 65535.0::DOUBLE * 4) AS INT), 3) AS {c}0" for c in "rgb")
    out = ", ".join(f"CAST(floor(least(65535, greatest(0, ({value(c)}) * 65535)) + 0.5) AS INT) AS {c}" for c in "rgb")
    return f"WITH {RGB}, a AS (SELECT *, {pos} FROM rgb), t AS (SELECT *, pr - r0 AS tr, pg - g0 AS tg, pb - b0 AS tb FROM a) SELECT f, y, x, {out} FROM t"


query("lut3d_apply", _lut_sql())(
    lambda s, d: col.lut3d(ad.colour(s, d), s.range(125).selectExpr("CAST(id % 5 AS INT) AS ri", "CAST((id DIV 5) % 5 AS INT) AS gi", "CAST(id DIV 25 AS INT) AS bi").selectExpr("*", "ri / 4D * (gi / 4D) AS r", "gi / 4D * (gi / 4D) AS g", "0.5D * (bi / 4D) + 0.5D * (ri / 4D) * (bi / 4D) AS b"), 5)
)
query(
    "neighbor_stats",
    f"""WITH {PX}, {_AROUND} SELECT a.f, a.y, a.x, count(*) AS k, round(avg(b.v), 6) AS mean, min(b.v) AS least FROM px a, o, px b WHERE (oy <> 0 OR ox <> 0) AND b.f = a.f AND b.y = a.y + oy AND b.x = a.x + ox GROUP BY ALL""",
)(lambda s, d: cal.neighbourhood(ad.pixels(s, d), 16, 16, ["f"], itself=False).selectExpr("f", "y", "x", "CAST(size(near) AS BIGINT) AS k", "round(aggregate(near, 0D, (a, q) -> a + q) / size(near), 6) AS mean", "near[0] AS least"))

# Temporal, without motion -------------------------------------------------------------


def _clip_samples(s: SparkSession, d: str) -> DataFrame:
    return tm.samples(ad.pixels(s, d), ad.frame_count(s, d), 15, 16, 16)


def _temporal(name: str, sql: str, fn=None) -> None:
    query(name, f"WITH {SAMPLES}, {sql}")(lambda s, d: (fn or tm.TECHNIQUES[name])(_clip_samples(s, d), ad.SIGMA, 16, 16))


_Z = f"zs AS (SELECT *, {z('s')} AS z, {z('c')} AS zc FROM s)"


def _bilateral_sql(h: float) -> str:
    return f"""{_Z}, a AS (SELECT f, y, x, max(c) AS c, max(zc) AS zc, sum(w) AS sw, sum(w * z) AS swz, sum(k) AS k FROM
        (SELECT *, CASE WHEN nf = f THEN 0 ELSE exp(-(z - zc) * (z - zc) / (2 * {h}::DOUBLE * {h}::DOUBLE)) END AS w, CASE WHEN nf = f THEN 0 ELSE 1 END AS k FROM zs WHERE nf = f OR abs(z - zc) <= 3) GROUP BY f, y, x),
    e AS (SELECT *, CASE WHEN sw > 0 AND 1 / (1 + sw) < 0.3 THEN 0.7::DOUBLE / (0.3::DOUBLE * sw) ELSE 1 END AS sc FROM a)
    SELECT f, y, x, CASE WHEN k = 0 THEN CAST(c AS INT) ELSE {back('((zc + swz * sc) / (1 + sw * sc))')} END AS v FROM e"""


_WIENER = f"""{_Z}, a AS (SELECT f, y, x, max(c) AS c, max(zc) AS zc, count(*) AS k, avg(z) AS m, avg(z * z) - avg(z) * avg(z) AS var FROM zs WHERE abs(z - zc) <= 3 GROUP BY f, y, x),
    e AS (SELECT *, CASE WHEN k <= 1 THEN zc ELSE m + CASE WHEN var > 0.01 THEN greatest(var - 1, 0) / var ELSE 0 END * (zc - m) END AS z FROM a)"""


def _guided_sql(epsilon: float) -> str:
    rows, cols = "PARTITION BY f, py, px, sy ORDER BY sx RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING", "PARTITION BY f, py, px, sx ORDER BY sy RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING"
    box = lambda src, out, sums: f"{out}1 AS (SELECT *, {', '.join(f'sum({e}) OVER ({rows}) AS {c}_' for c, e in sums.items())} FROM {src}), {out} AS (SELECT *, {', '.join(f'sum({c}_) OVER ({cols}) AS {c}' for c in sums)} FROM {out}1)"
    return f"""{_WIENER}, grid AS (SELECT f, y, x, zc AS g, z AS p, y % 2 AS py, x % 2 AS px, y // 2 AS sy, x // 2 AS sx FROM e),
    {box('grid', 'h', {'n': '1.0::DOUBLE', 'sg': 'g', 'sp': 'p', 'sgg': 'g * g', 'sgp': 'g * p'})},
    ab AS (SELECT f, y, x, g, py, px, sy, sx, n, (sgp / n - sg / n * sp / n) / (sgg / n - sg / n * sg / n + {epsilon}::DOUBLE) AS a, sp / n AS mp, sg / n AS mg FROM h),
    ab2 AS (SELECT *, mp - a * mg AS b FROM ab), {box('ab2', 'q', {'sa': 'a', 'sb': 'b'})}
    SELECT f, y, x, {back('(sa / n * g + sb / n)')} AS v FROM q"""


def _patch_sql(radius: int, distance: str, src: str) -> str:
    span = list(range(-radius, radius + 1))
    return f"""o AS (SELECT a.y * 2 AS oy, b.x * 2 AS ox FROM (SELECT unnest({span}) AS y) a, (SELECT unnest({span}) AS x) b),
    d AS (SELECT a.f, a.nf, a.y, a.x, avg({distance}) AS d2, count(*) AS k FROM {src} a, o, {src} b
          WHERE a.nf <> a.f AND b.f = a.f AND b.nf = a.nf AND b.y = a.y + oy AND b.x = a.x + ox GROUP BY a.f, a.nf, a.y, a.x)"""


_LIMIT = duck(tm.reject_limit("c", SG)).replace("((CAST(c AS INT)) >> 8)", "(CAST(c AS INT) >> 8)")
for _name, _h in (("vst_bilateral", 1.0), ("vst_bilateral_tight", 0.8), ("vst_bilateral_wide", 1.2)):
    _temporal(_name, _bilateral_sql(_h))
_temporal("vst_wiener", f"{_WIENER} SELECT f, y, x, CASE WHEN k <= 1 THEN CAST(c AS INT) ELSE {back('z')} END AS v FROM e")
_temporal("inv_variance", f"q AS (SELECT *, 1 / (pow({sig('s')}, 2) + 1) AS w FROM s WHERE abs(s - c) <= 3 * {sig('c')}) SELECT f, y, x, {px_of('round(sum(w * s) / sum(w), 6)')} AS v FROM q GROUP BY f, y, x")
_temporal(
    "sigma_clip",
    f"""m1 AS (SELECT f, y, x, avg(s) AS m FROM s GROUP BY f, y, x), k1 AS (SELECT s.* FROM s JOIN m1 USING (f, y, x) WHERE abs(s - m) <= 2.5 * {sig('c')}),
    m2 AS (SELECT f, y, x, avg(s) AS m FROM k1 GROUP BY f, y, x), k2 AS (SELECT k1.* FROM k1 JOIN m2 USING (f, y, x) WHERE abs(s - m) <= 2.5 * {sig('c')}),
    r AS (SELECT f, y, x, avg(s) AS m FROM k2 GROUP BY f, y, x) SELECT px.f, px.y, px.x, {px_of('coalesce(round(m, 6), px.v)')} AS v FROM px LEFT JOIN r USING (f, y, x)""",
)
_temporal(
    "dct_shrink",
    f"""q AS (SELECT f, y, x, c, nf, CASE WHEN abs(s - c) > 3 * {sig('c')} THEN c ELSE s END AS s, row_number() OVER (PARTITION BY f, y, x ORDER BY nf) - 1 AS i, count(*) OVER (PARTITION BY f, y, x) AS n FROM s),
    ks AS (SELECT unnest(range(32)) AS k),
    d AS (SELECT f, y, x, k, max(c) AS c, max(n) AS n, max(CASE WHEN nf = f THEN i END) AS ctr, sum(s * CASE WHEN k = 0 THEN sqrt(1.0::DOUBLE / n) ELSE sqrt(2.0::DOUBLE / n) END * cos(pi() * k * (2 * i + 1) / (2 * n))) AS d FROM q JOIN ks ON k < n GROUP BY f, y, x, k),
    r AS (SELECT f, y, x, max(c) AS c, max(n) AS n, sum(CASE WHEN k > 0 AND abs(d) < 3 * {sig('c')} / sqrt(n) THEN 0 ELSE d END * CASE WHEN k = 0 THEN sqrt(1.0::DOUBLE / n) ELSE sqrt(2.0::DOUBLE / n) END * cos(pi() * k * (2 * ctr + 1) / (2 * n))) AS v FROM d GROUP BY f, y, x)
    SELECT f, y, x, CASE WHEN n < 3 THEN CAST(c AS INT) ELSE {px_of('v')} END AS v FROM r""",
)
for _name, _e in (("vst_guided", 1.0), ("vst_guided_tight", 0.1), ("vst_guided_mid", 0.3)):
    _temporal(_name, _guided_sql(_e))
_temporal(
    "vst_nlm",
    f"""{_Z.replace("zs AS (", "zs AS MATERIALIZED (")},
    g AS (SELECT f, nf, y, x, (z - zc) * (z - zc) AS d, y // 2 AS sy, x // 2 AS sx, y % 2 AS py, x % 2 AS px FROM zs WHERE nf <> f),
    h AS (SELECT *, sum(d) OVER w AS rd, count(*) OVER w AS rk FROM g WINDOW w AS (PARTITION BY f, nf, y, px ORDER BY sx RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    d AS (SELECT f, nf, y, x, sum(rd) OVER w / sum(rk) OVER w AS d2, sum(rk) OVER w AS k FROM h WINDOW w AS (PARTITION BY f, nf, x, py ORDER BY sy RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    w AS (SELECT zs.f, zs.y, zs.x, sum(exp(-d2 / 2)) AS sw, sum(exp(-d2 / 2) * z) AS swz FROM zs JOIN d USING (f, nf, y, x) WHERE k >= 5 AND d2 <= 9 GROUP BY zs.f, zs.y, zs.x)
    SELECT a.f, a.y, a.x, CASE WHEN a.y BETWEEN 2 AND 13 AND a.x BETWEEN 2 AND 13 THEN {back('((0.4::DOUBLE * zc + coalesce(swz, 0)) / (0.4::DOUBLE + coalesce(sw, 0)))')} ELSE CAST(c AS INT) END AS v
    FROM zs a LEFT JOIN w USING (f, y, x) WHERE a.nf = a.f""",
)
_temporal(
    "nlm_baseline",
    f"""{_patch_sql(1, '(b.s - b.c) * (b.s - b.c)', 's')},
    w AS (SELECT s.*, d2, {_LIMIT} AS t, 616.0::DOUBLE * (1 + 0.5 * least(1, greatest(0, 1 - c / 8000))) AS h FROM s JOIN d USING (f, nf, y, x)),
    g AS (SELECT *, exp(-d2 / (2 * h * h)) * CASE WHEN c < 10000 AND s > c THEN exp(-2 * pow((s - c) / greatest(t, 1), 2)) ELSE 1 END AS w FROM w WHERE sqrt(d2) <= t),
    r AS (SELECT f, y, x, sum(w) AS sw, sum(w * s) AS sws FROM g GROUP BY f, y, x)
    SELECT px.f, px.y, px.x, {px_of('round((v + coalesce(sws, 0)) / (1 + coalesce(sw, 0)), 6)')} AS v FROM px LEFT JOIN r USING (f, y, x)""",
)
query("temporal_samples", f"WITH {SAMPLES} SELECT f, y, x, count(*) AS k, CAST(sum(s) AS BIGINT) AS total FROM s GROUP BY f, y, x")(
    lambda s, d: _clip_samples(s, d).groupBy("f", "y", "x").agg(F.count("*").alias("k"), F.sum("s").cast("long").alias("total"))
)


def _tiles(s: SparkSession, d: str) -> DataFrame:
    from frameloom.operators.tiles import denoise
    from frameloom.sources.frames import from_pixels, to_pixels

    frames = from_pixels(ad.pixels(s, d).selectExpr("'clip' AS clip_id", "f", "y", "x", "v"), 16, 16)
    return to_pixels(denoise(frames, "vst_bilateral", ad.SIGMA)).select("f", "y", "x", "v")


query("tiles_bilateral", f"WITH {SAMPLES}, {_bilateral_sql(1.0)}")(_tiles)
query("technique_sweep", " UNION ALL ".join(f"SELECT '{t}' AS technique, f, y, x, v FROM ({ORACLES[t]})" for t in tm.TECHNIQUES))(
    lambda s, d: tm.sweep(_clip_samples(s, d), ad.SIGMA, 16, 16)
)
query(
    "neighbour_cap",
    f"WITH {PX}, fr AS (SELECT DISTINCT f FROM px), p AS (SELECT a.f, b.f AS nf, row_number() OVER (PARTITION BY a.f ORDER BY abs(b.f - a.f), b.f) AS rank FROM fr a JOIN fr b ON b.f BETWEEN a.f - 7 AND a.f + 7 AND a.f <> b.f) SELECT f, nf, CAST(rank AS INT) AS rank FROM p WHERE rank <= 6",
)(lambda s, d: tm.nearest_neighbours(s.range(ad.frame_count(s, d)).selectExpr("CAST(id AS INT) AS f").withColumn("nf", F.explode(F.expr(f"filter(sequence(f - 7, f + 7), q -> q <> f AND q BETWEEN 0 AND {ad.frame_count(s, d) - 1})"))), 6))

# Temporal, with motion ------------------------------------------------------------------

#: Constant motion: half a pixel right and a quarter up for each frame.
_FLOW = "CAST(0.5 * (b.f - a.f) AS DOUBLE) AS dx, CAST(-0.25 * (b.f - a.f) AS DOUBLE) AS dy"


def _constant_flow(s: SparkSession, d: str, reach: int = 2) -> DataFrame:
    n = ad.frame_count(s, d)
    pairs = s.range(n).selectExpr("CAST(id AS INT) AS f").withColumn("nf", F.explode(F.expr(f"filter(sequence(f - {reach}, f + {reach}), q -> q <> f AND q BETWEEN 0 AND {n - 1})")))
    cells = pairs.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(63)))).selectExpr("f", "nf", "CAST(c DIV 8 AS INT) AS gy", "c % 8 AS gx")
    return cells.selectExpr("*", "0.5D * (nf - f) AS dx", "-0.25D * (nf - f) AS dy")


def _moved_sql() -> str:
    even = lambda s: f"(CAST(floor({s}) AS INT) - ((CAST(floor({s}) AS INT) % 2) + 2) % 2)"
    snap = lambda s, a: f"({even(s)} + CASE WHEN {a} % 2 = 0 THEN 0 WHEN {even(s)} < CAST(trunc({s}) AS INT) THEN 1 ELSE -1 END)"
    return f"""{PX}, fr AS (SELECT DISTINCT f FROM px), fl AS (SELECT a.f, b.f AS nf, {_FLOW} FROM fr a JOIN fr b ON b.f <> a.f AND b.f BETWEEN a.f - 2 AND a.f + 2),
    aim AS (SELECT px.f, px.y, px.x, CAST(px.v AS DOUBLE) AS c, nf, dx, dy, px.x + 2 * dx AS sx, px.y + 2 * dy AS sy FROM px JOIN fl USING (f)),
    b0 AS (SELECT *, {snap('sx', 'x')} AS x0, {snap('sy', 'y')} AS y0 FROM aim),
    fr2 AS (SELECT *, least(1, greatest(0, (sx - x0) / 2)) AS tx, least(1, greatest(0, (sy - y0) / 2)) AS ty FROM b0 WHERE x0 >= 0 AND x0 + 2 < 16 AND y0 >= 0 AND y0 + 2 < 16),
    w AS (SELECT t.f, t.y, t.x, t.nf, t.c, sqrt(dx * dx + dy * dy) AS mag, (1 - tx) * (1 - ty) * p.v + tx * (1 - ty) * q.v + (1 - tx) * ty * r.v + tx * ty * u.v AS s FROM fr2 t
          JOIN px p ON p.f = nf AND p.y = y0 AND p.x = x0 JOIN px q ON q.f = nf AND q.y = y0 AND q.x = x0 + 2 JOIN px r ON r.f = nf AND r.y = y0 + 2 AND r.x = x0 JOIN px u ON u.f = nf AND u.y = y0 + 2 AND u.x = x0 + 2)"""


def _moved(s: SparkSession, d: str) -> DataFrame:
    return tm.moved_samples(ad.pixels(s, d), _constant_flow(s, d), ad.frame_count(s, d), 5, 16, 16)


query("warp_bilinear", f"WITH {_moved_sql()} SELECT w.f, w.y, w.x, w.nf, round(s, 6) AS s FROM w, n, LATERAL (SELECT least(greatest(w.f - 2, 0), greatest(n.n - 5, 0)) AS lo) WHERE nf BETWEEN lo AND lo + 4")(
    lambda s, d: _moved(s, d).where("nf <> f").selectExpr("f", "y", "x", "nf", "round(s, 6) AS s")
)
query(
    "bilateral_flow",
    f"""WITH {_moved_sql()}, s AS (SELECT w.f, y, x, c, nf, s, mag FROM w, n, LATERAL (SELECT least(greatest(w.f - 2, 0), greatest(n.n - 5, 0)) AS lo) WHERE nf BETWEEN lo AND lo + 4),
    {_Z}, a AS (SELECT f, y, x, max(zc) AS zc, max(c) AS c, sum(exp(-(z - zc) * (z - zc) / 2) * exp(-mag * mag / 8)) AS sw, sum(exp(-(z - zc) * (z - zc) / 2) * exp(-mag * mag / 8) * z) AS swz, max(mag) AS mag FROM zs WHERE abs(z - zc) <= 3 GROUP BY f, y, x),
    b AS (SELECT *, 0.3::DOUBLE + 0.3::DOUBLE * least(mag / 3, 1) AS fl FROM a), e AS (SELECT *, CASE WHEN 1 / (1 + sw) < fl THEN (1 - fl) / (fl * sw) ELSE 1 END AS sc FROM b)
    SELECT px.f, px.y, px.x, CASE WHEN e.zc IS NULL THEN px.v ELSE {back('((zc + swz * sc) / (1 + sw * sc))')} END AS v FROM px LEFT JOIN e USING (f, y, x)""",
)(lambda s, d: tm.bilateral(_moved(s, d), ad.SIGMA))
query(
    "far_flow_scale",
    f"""WITH {PX}, fr AS (SELECT DISTINCT f FROM px), p AS (SELECT a.f, b.f AS nf, abs(b.f - a.f) AS far, sign(b.f - a.f) AS side FROM fr a JOIN fr b ON b.f <> a.f AND b.f BETWEEN a.f - 7 AND a.f + 7)
    SELECT f, nf, CAST(g.g // 8 AS INT) AS gy, CAST(g.g % 8 AS INT) AS gx, round(0.5 * (nf - f), 6)::DOUBLE AS dx, round(-0.25 * (nf - f), 6)::DOUBLE AS dy FROM p, (SELECT unnest(range(64)) AS g) g""",
)(lambda s, d: tm.far_flow(_constant_flow(s, d, 7).selectExpr("f", "nf", "gy", "gx", "CASE WHEN abs(nf - f) <= 2 THEN dx ELSE 99D END AS dx", "CASE WHEN abs(nf - f) <= 2 THEN dy ELSE 99D END AS dy")).selectExpr("f", "nf", "gy", "gx", "round(dx, 6) AS dx", "round(dy, 6) AS dy"))
query(
    "iir_flow",
    f"WITH RECURSIVE {PX}, a AS (SELECT f, avg(v) / 1000 AS avg FROM px GROUP BY f), r AS (SELECT -1 AS f, 2.0::DOUBLE AS s UNION ALL SELECT a.f, 0.1 * a.avg + 0.9 * r.s FROM r JOIN a ON a.f = r.f + 1) SELECT f, round(s, 6) AS s FROM r WHERE f >= 0",
)(lambda s, d: rounded(tm.smoothed_flow(ad.pixels(s, d).groupBy("f").agg((F.avg("v") / 1000).alias("avg"))), ["s"]))

# Motion -----------------------------------------------------------------------------------

query("downsample2", f"WITH {PX}, {_GREEN} SELECT f, y // 2 AS y, x // 2 AS x, CAST(sum(v) // 4 AS INT) AS v FROM g GROUP BY f, y // 2, x // 2")(lambda s, d: mo.downsample(mo.green_plane(ad.pixels(s, d))))


def _starts(s: SparkSession, d: str, grid: int) -> DataFrame:
    pairs = s.range(1, ad.frame_count(s, d)).selectExpr("CAST(id AS INT) AS f", "CAST(id - 1 AS INT) AS nf")
    return pairs.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1)))).selectExpr("f", "nf", f"CAST(g DIV {grid} AS INT) AS gy", f"g % {grid} AS gx", "0 AS dy", "0 AS dx")


_BLOCKS = f"""{_GREEN}, o AS (SELECT a.v AS dy, b.v AS dx FROM (SELECT unnest(range(-2, 3)) AS v) a, (SELECT unnest(range(-2, 3)) AS v) b),
    c AS (SELECT a.f, a.f - 1 AS nf, a.y // 4 AS gy, a.x // 4 AS gx, dy, dx, CAST(sum(CASE WHEN b.v IS NULL THEN 32768 ELSE abs(a.v - b.v) END) AS BIGINT) AS sad FROM g a CROSS JOIN o LEFT JOIN g b ON b.f = a.f - 1 AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.f > 0 GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f, gy, gx ORDER BY sad, dy, dx) AS rn FROM c) WHERE rn = 1)"""
query("block_sad", f"WITH {PX}, {_BLOCKS} SELECT f, nf, gy, gx, sad FROM c WHERE dy = 0 AND dx = 0")(
    lambda s, d: mo.search(mo.green_plane(ad.pixels(s, d)), _starts(s, d, 2), 4, 0).select("f", "nf", "gy", "gx", "sad")
)
query("block_match_int", f"WITH {PX}, {_BLOCKS} SELECT f, nf, gy, gx, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, sad FROM best")(lambda s, d: mo.search(mo.green_plane(ad.pixels(s, d)), _starts(s, d, 2), 4, 2))
query(
    "block_match_halfpel",
    f"""WITH {PX}, {_BLOCKS}, h AS (SELECT b.f, b.gy, b.gx, b.dy * 2 + p.v AS dy, b.dx * 2 + q.v AS dx, (p.v <> 0 OR q.v <> 0) AS moved FROM best b, (SELECT unnest([-1, 0, 1]) AS v) p, (SELECT unnest([-1, 0, 1]) AS v) q),
    k AS (SELECT h.*, a.y, a.x, a.v, h.dy & 1 AS fy, h.dx & 1 AS fx, a.y + (h.dy >> 1) AS ny, a.x + (h.dx >> 1) AS nx FROM h JOIN g a ON a.f = h.f AND a.y // 4 = h.gy AND a.x // 4 = h.gx),
    m AS (SELECT k.*, e.v AS e, r.v AS r, d.v AS d, z.v AS z FROM k LEFT JOIN g e ON e.f = k.f - 1 AND e.y = ny AND e.x = nx LEFT JOIN g r ON r.f = k.f - 1 AND r.y = ny AND r.x = nx + 1 LEFT JOIN g d ON d.f = k.f - 1 AND d.y = ny + 1 AND d.x = nx LEFT JOIN g z ON z.f = k.f - 1 AND z.y = ny + 1 AND z.x = nx + 1),
    t AS (SELECT f, gy, gx, dy, dx, moved, CAST(sum(CASE WHEN fy = 0 AND fx = 0 THEN coalesce(abs(v - e), 32768) WHEN fy = 0 THEN coalesce(abs(v - (e + r + 1) // 2), 32768) WHEN fx = 0 THEN coalesce(abs(v - (e + d + 1) // 2), 32768) ELSE coalesce(abs(v - (e + r + d + z + 2) // 4), 32768) END) AS BIGINT) AS sad FROM m GROUP BY f, gy, gx, dy, dx, moved)
    SELECT f, f - 1 AS nf, gy, gx, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, sad FROM (SELECT *, row_number() OVER (PARTITION BY f, gy, gx ORDER BY sad, moved, dy, dx) AS rn FROM t) WHERE rn = 1""",
)(lambda s, d: (lambda g: mo.refine_half(g, mo.search(g, _starts(s, d, 2), 4, 2), 4))(mo.green_plane(ad.pixels(s, d))))
query("motion_estimate")(lambda s, d: mo.estimate(mo.green_plane(ad.pixels(s, d, 32)), s.range(1, max(1, ad.frame_count(s, d, 32))).selectExpr("CAST(id AS INT) AS f", "CAST(id - 1 AS INT) AS nf"), 8, 16, 16))
query("motion_stats", f"WITH {PX}, {_BLOCKS}, p AS (SELECT f, avg(sqrt(dx * dx + dy * dy)) AS m FROM best GROUP BY f) SELECT count(*) AS pairs, round(list_sort(list(m))[count(*) // 2 + 1], 6) AS median, round(max(m), 6) AS largest FROM p")(
    lambda s, d: rounded(mo.motion_stats(mo.search(mo.green_plane(ad.pixels(s, d)), _starts(s, d, 2), 4, 2), 1.0), ["median", "largest"])
)
query("center_weight", f"WITH {PX}, {_BLOCKS}, p AS (SELECT f, nf, avg(sqrt(dx * dx + dy * dy)) AS m FROM best WHERE (gy * 2 + gx) % 16 = 0 AND sqrt(dx * dx + dy * dy) < 20 GROUP BY f, nf) SELECT f, round(0.3 + 0.3 * least(1, avg(m) / 3), 6) AS weight FROM p GROUP BY f")(
    lambda s, d: rounded(mo.centre_weight(mo.search(mo.green_plane(ad.pixels(s, d)), _starts(s, d, 2), 4, 2).selectExpr("f", "nf", "gy * 2 + gx AS cell", "sqrt(dx * dx + dy * dy) AS mag")), ["weight"])
)

# Spatial and transforms ------------------------------------------------------------------------

_HAAR = f"""{EMB}, q AS (SELECT id, y // 2 AS y, x // 2 AS x, max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v END) AS a, max(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN v END) AS b, max(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN v END) AS c, max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v END) AS d FROM emb GROUP BY id, y // 2, x // 2),
    bands AS (SELECT id, 'LL' AS band, y, x, (a + b + c + d) / 4 AS v FROM q UNION ALL SELECT id, 'HL', y, x, (a - b + c - d) / 4 FROM q UNION ALL SELECT id, 'LH', y, x, (a + b - c - d) / 4 FROM q UNION ALL SELECT id, 'HH', y, x, (a - b - c + d) / 4 FROM q)"""
_MAD = "t AS (SELECT band, max(abs(v)) AS top, count(*) AS n FROM bands GROUP BY band), hs AS (SELECT band, CAST(least(4095, floor(abs(v) / top * 4095)) AS INT) AS bin, max(top) AS top, max(n) AS n, count(*) AS c FROM bands JOIN t USING (band) GROUP BY ALL), ru AS (SELECT *, sum(c) OVER (PARTITION BY band ORDER BY bin) AS run FROM hs), mad AS (SELECT band, min((bin + 0.5) * top / 4095) / 0.6745 AS sigma FROM ru WHERE run > n // 2 GROUP BY band)"
query("haar_l1", f"WITH {_HAAR} SELECT id, band, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v FROM bands")(lambda s, d: sp.haar(ad.blocks(s, d), ["id"]))
query("haar_roundtrip", f"WITH {EMB} SELECT id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(v AS DOUBLE) AS v FROM emb")(lambda s, d: sp.inverse_haar(sp.haar(ad.blocks(s, d), ["id"]), ["id"]))
query("mad_sigma", f"WITH {_HAAR}, {_MAD} SELECT band, round(sigma, 6) AS sigma FROM mad")(
    lambda s, d: rounded(sp.mad_sigma(sp.haar(ad.blocks(s, d), ["id"]).drop("id"), ["band"]), ["sigma"])
)
query(
    "bayes_shrink",
    f"WITH {_HAAR}, {_MAD}, th AS (SELECT band, CASE WHEN sigma * sigma > 10000 THEN 10000 / sqrt(sigma * sigma - 10000) ELSE 3 * sigma END AS t FROM mad) SELECT id, band, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(CASE WHEN band = 'LL' THEN v ELSE sign(v) * greatest(abs(v) - t, 0) END, 6) AS v FROM bands JOIN th USING (band)",
)(lambda s, d: rounded(sp.bayes_shrink(sp.haar(ad.blocks(s, d), ["id"]).withColumn("g", F.lit(0)).withColumnRenamed("y", "yy").selectExpr("g", "band", "CAST(id * 100 + yy AS INT) AS y", "x", "v"), ["g"], 100.0).selectExpr("CAST(y DIV 100 AS BIGINT) AS id", "band", "y % 100 AS y", "x", "v"), ["v"]))
query(
    "green_bilateral",
    f"""WITH {PX}, {_GREEN}, k AS (SELECT a.v AS oy, b.v AS ox, CASE a.v * a.v + b.v * b.v WHEN 0 THEN 1.0 WHEN 1 THEN 0.6065 WHEN 2 THEN 0.3679 WHEN 4 THEN 0.1353 WHEN 5 THEN 0.0821 ELSE 0.0183 END::DOUBLE AS k FROM (SELECT unnest(range(-2, 3)) AS v) a, (SELECT unnest(range(-2, 3)) AS v) b),
    p AS (SELECT c.f, c.y, c.x, s.v AS s, k, (s.v - c.v)::DOUBLE * (s.v - c.v) / (4 * 616.0::DOUBLE * 616) AS arg FROM g c, k, g s WHERE s.f = c.f AND s.y = c.y - oy AND s.x = c.x - ox),
    w AS (SELECT *, k * CASE WHEN arg < 10 THEN exp(-floor(arg * 102.3) / 102.3) ELSE 0 END AS w FROM p) SELECT f, y, x, {px_of('(sum(w * s) / sum(w))')} AS v FROM w GROUP BY f, y, x""",
)(lambda s, d: sp.green_bilateral(mo.green_plane(ad.pixels(s, d)), ad.SIGMA))
query(
    "unsharp",
    f"""WITH {PX}, {_AROUND}, a AS (SELECT c.f, c.y, c.x, c.v, CAST(sum(b.v) // 8 AS INT) AS m FROM px c, o, px b WHERE (oy <> 0 OR ox <> 0) AND c.y BETWEEN 2 AND 13 AND c.x BETWEEN 2 AND 13 AND b.f = c.f AND b.y = c.y + oy AND b.x = c.x + ox GROUP BY c.f, c.y, c.x, c.v)
    SELECT px.f, px.y, px.x, CASE WHEN m IS NULL THEN px.v ELSE least(65535, greatest(0, px.v + CAST(trunc(0.45::DOUBLE * least(1, abs(px.v - m) / 154.0::DOUBLE) * (px.v - m)) AS INT))) END AS v FROM px LEFT JOIN a USING (f, y, x)""",
)(lambda s, d: sp.unsharp(ad.pixels(s, d), 0.45, ad.SIGMA, 16, 16))
query(
    "dct8_fwd",
    f"""WITH {EMB}, b AS (SELECT k.k, i.i, CASE WHEN k.k = 0 THEN sqrt(1.0::DOUBLE / 8) ELSE sqrt(2.0::DOUBLE / 8) END * cos(pi() * k.k * (2 * i.i + 1) / 16) AS b FROM (SELECT unnest(range(8)) AS k) k, (SELECT unnest(range(8)) AS i) i),
    r AS (SELECT id, y, k AS x, sum(v * b) AS v FROM emb JOIN b ON i = x GROUP BY id, y, k) SELECT id, CAST(k AS INT) AS y, CAST(x AS INT) AS x, round(sum(v * b), 4) + 0.0 AS v FROM r JOIN b ON i = y GROUP BY id, k, x""",
)(lambda s, d: sp.dct(ad.blocks(s, d), ["id"]).withColumn("v", F.round("v", 4) + F.lit(0.0)))
query("dct8_roundtrip", f"WITH {EMB} SELECT id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v FROM emb")(lambda s, d: sp.dct(sp.dct(ad.blocks(s, d), ["id"]), ["id"], inverse=True).withColumn("v", F.round("v").cast("int")))
query(
    "dwt26_fwd",
    f"""WITH {EMB}, p AS (SELECT id, y, x // 2 AS p, max(CASE WHEN x % 2 = 0 THEN v END) AS a, max(CASE WHEN x % 2 = 1 THEN v END) AS b FROM emb GROUP BY id, y, x // 2),
    l AS (SELECT *, a + b AS low, lag(a + b) OVER w AS q, lead(a + b) OVER w AS s, lag(a + b, 2) OVER w AS q2, lead(a + b, 2) OVER w AS s2 FROM p WINDOW w AS (PARTITION BY id, y ORDER BY p))
    SELECT id, CAST(y AS INT) AS y, CAST(p AS INT) AS p, low, CASE WHEN q IS NULL THEN (5 * a - 11 * b + 4 * s - s2 + 4) >> 3 WHEN s IS NULL THEN (11 * a - 5 * b - 4 * q + q2 + 4) >> 3 ELSE ((s - q + 4) >> 3) + a - b END AS high FROM l""",
)(lambda s, d: sp.wavelet_26(ad.blocks(s, d).withColumnRenamed("x", "i"), ["id", "y"], 8))

# Video ------------------------------------------------------------------------------------------

_YUV = """l AS (SELECT *, CAST(trunc(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) AS INT) AS l FROM rgb),
    p AS (SELECT a.f, a.y, a.x // 2 AS xc, a.l AS l0, b.l AS l1, (a.b + b.b) // 2 - (a.l + b.l) // 2 AS u, (a.r + b.r) // 2 - (a.l + b.l) // 2 AS w FROM l a JOIN l b ON b.f = a.f AND b.y = a.y AND b.x = a.x + 1 WHERE a.x % 2 = 0),
    yuv AS (SELECT f, y, xc, least(65535, greatest(0, l0)) >> 6 AS y0, least(65535, greatest(0, l1)) >> 6 AS y1, least(65535, greatest(0, CAST(trunc(u * 0.5389::DOUBLE) AS INT) + 32768)) >> 6 AS cb, least(65535, greatest(0, CAST(trunc(w * 0.635::DOUBLE) AS INT) + 32768)) >> 6 AS cr FROM p)"""
query("rgb_to_yuv422", f"WITH {RGB}, {_YUV} SELECT * FROM yuv")(lambda s, d: vi.rgb_to_yuv422(ad.colour(s, d)))
query(
    "yuv422_to_rgb",
    f"""WITH {RGB}, {_YUV}, q AS (SELECT f, y, xc * 2 AS x, y0 * 64 AS l, cb * 64 - 32768 AS u, cr * 64 - 32768 AS w FROM yuv UNION ALL SELECT f, y, xc * 2 + 1, y1 * 64, cb * 64 - 32768, cr * 64 - 32768 FROM yuv)
    SELECT f, y, CAST(x AS INT) AS x, least(65535, greatest(0, l + CAST(trunc(1.5748::DOUBLE * w) AS INT))) AS r, least(65535, greatest(0, l - CAST(trunc(0.1873::DOUBLE * u) AS INT) - CAST(trunc(0.4681::DOUBLE * w) AS INT))) AS g, least(65535, greatest(0, l + CAST(trunc(1.8556::DOUBLE * u) AS INT))) AS b FROM q""",
)(lambda s, d: vi.yuv422_to_rgb(vi.rgb_to_yuv422(ad.colour(s, d)).selectExpr("f", "y", "xc", "y0 * 64 AS y0", "y1 * 64 AS y1", "cb * 64 AS cb", "cr * 64 AS cr")))
query(
    "bayer_to_rgb",
    f"""WITH {PX}, c AS (SELECT f, y // 2 AS cy, x // 2 AS cx, max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v END) AS r, CAST(sum(CASE WHEN y % 2 <> x % 2 THEN v END) // 2 AS INT) AS g, max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v END) AS b FROM px GROUP BY ALL)
    SELECT px.f, px.y, px.x, r, g, b FROM px JOIN c ON c.f = px.f AND c.cy = px.y // 2 AND c.cx = px.x // 2""",
)(lambda s, d: vi.mosaic_to_rgb(ad.pixels(s, d)))
query(
    "film_grain",
    f"""WITH RECURSIVE {PX}, r AS (SELECT f, 0 AS i, (12345 + f)::BIGINT AS s FROM (SELECT DISTINCT f FROM px) UNION ALL SELECT f, i + 1, (1664525 * s + 1013904223) % 4294967296 FROM r WHERE i < 768),
    g AS (SELECT f, (i - 1) // 3 AS p, sum((s >> 16) - 32768) AS n FROM r WHERE i > 0 GROUP BY f, (i - 1) // 3)
    SELECT px.f, px.y, px.x, least(65535, greatest(0, v + CAST(trunc(n / (32768 * 1.732::DOUBLE) * (120.0::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * (v / 65535.0::DOUBLE)))) AS INT))) AS v FROM px JOIN g ON g.f = px.f AND g.p = px.y * 16 + px.x""",
)(lambda s, d: vi.film_grain(ad.pixels(s, d), 0.3, 16, height=16))
query(
    "luma_fill",
    f"""WITH {PX}, m AS (SELECT a.f, a.y, a.x, CAST(sum(b.v) // count(*) AS INT) AS m FROM px a JOIN px b ON b.f = a.f AND abs(b.y - a.y) + abs(b.x - a.x) = 1 WHERE a.y % 2 = a.x % 2 GROUP BY a.f, a.y, a.x)
    SELECT px.f, px.y, px.x, coalesce(m, v) AS luma, v - coalesce(m, v) + 2048 AS residual FROM px LEFT JOIN m USING (f, y, x)""",
)(lambda s, d: vi.luma_fill(ad.pixels(s, d)))
_BLEND = vi.blend_schedule("(v / 100D)", "(f / 5D)")
query("blend_schedule", f"WITH {PX} SELECT f, y, x, " + ", ".join(f"{'' if c == 'second' else 'round('}{duck(e)}{'' if c == 'second' else ', 6)'} AS {c}" for c, e in _BLEND.items()) + " FROM px")(
    lambda s, d: ad.pixels(s, d).selectExpr("f", "y", "x", *(f"{e} AS {c}" if c == "second" else f"round({e}, 6) AS {c}" for c, e in _BLEND.items()))
)
query(
    "dwt53_fwd",
    f"""WITH {EMB}, p AS (SELECT id, y, x // 2 AS p, max(CASE WHEN x % 2 = 0 THEN v END) AS a, max(CASE WHEN x % 2 = 1 THEN v END) AS b FROM emb GROUP BY id, y, x // 2),
    h AS (SELECT *, b - ((a + coalesce(lead(a) OVER w, a)) >> 1) AS high FROM p WINDOW w AS (PARTITION BY id, y ORDER BY p))
    SELECT id, CAST(y AS INT) AS y, CAST(p AS INT) AS p, a + ((coalesce(lag(high) OVER w, high) + high + 2) >> 2) AS low, high FROM h WINDOW w AS (PARTITION BY id, y ORDER BY p)""",
)(lambda s, d: vi.lifting_53(ad.blocks(s, d).withColumnRenamed("x", "i"), ["id", "y"], 8).selectExpr("id", "y", "p", "low", "high"))
query("dwt53_roundtrip", f"WITH {EMB} SELECT id, CAST(y AS INT) AS y, CAST(x AS INT) AS i, v FROM emb")(
    lambda s, d: vi.lifting_53(vi.lifting_53(ad.blocks(s, d).withColumnRenamed("x", "i"), ["id", "y"], 8), ["id", "y"], 8, inverse=True)
)


def _planes(s: SparkSession, d: str) -> DataFrame:
    return ad.colour(s, d).where(f"f < {ad.frame_count(s, d)}").selectExpr("f", "y", "x", "stack(3, 'r', r, 'g', g, 'b', b) AS (plane, v)")


query(
    "rgb_temporal",
    f"""WITH {RGB}, m AS (SELECT count(*) // 256 AS n FROM events), px AS (SELECT 'r' AS plane, f, y, x, r AS v FROM rgb, m WHERE f < n UNION ALL SELECT 'g', f, y, x, g FROM rgb, m WHERE f < n UNION ALL SELECT 'b', f, y, x, b FROM rgb, m WHERE f < n),
    s AS (SELECT a.plane, a.f, a.y, a.x, CAST(a.v AS DOUBLE) AS c, b.f AS nf, CAST(b.v AS DOUBLE) AS s FROM px a CROSS JOIN m JOIN px b ON a.plane = b.plane AND a.y = b.y AND a.x = b.x AND (b.f = a.f OR (b.f BETWEEN least(greatest(a.f - 2, 0), greatest(m.n - 5, 0)) AND least(greatest(a.f - 2, 0), greatest(m.n - 5, 0)) + 4 AND a.x + 2 < 16 AND a.y + 2 < 16))),
    q AS (SELECT *, 1 / (pow({sig('s')}, 2) + 1) AS w FROM s WHERE abs(s - c) <= 3 * {sig('c')}) SELECT plane, f, y, x, {px_of('round(sum(w * s) / sum(w), 6)')} AS v FROM q GROUP BY plane, f, y, x""",
)(lambda s, d: tm.inverse_variance(tm.samples(_planes(s, d), ad.frame_count(s, d), 5, 16, 16, by=("plane",)), ad.SIGMA, by=("plane",)))


def _recursive(s: SparkSession, d: str) -> DataFrame:
    from frameloom.sources.frames import from_pixels, to_pixels

    frames = from_pixels(ad.pixels(s, d).selectExpr("'clip' AS clip_id", "f", "y", "x", "v"), 16, 16)
    return to_pixels(vi.recursive(frames, "vst_bilateral", ad.SIGMA)).select("f", "y", "x", "v")


query("recursive_bilateral")(_recursive)


def _two_pass(s: SparkSession, d: str) -> DataFrame:
    """The first result as centre, the raw neighbours as before."""
    rows = tm.samples(ad.pixels(s, d), ad.frame_count(s, d), 5, 16, 16)
    first = tm.bilateral(rows, ad.SIGMA).withColumnRenamed("v", "c1")
    again = rows.join(first, ["f", "y", "x"]).withColumns({"c": F.col("c1").cast("double"), "s": F.expr("CASE WHEN nf = f THEN CAST(c1 AS DOUBLE) ELSE s END")}).drop("c1")
    return tm.bilateral(again, ad.SIGMA)


query(
    "preview_two_pass",
    f"""WITH {samples(5)}, one AS (WITH {_bilateral_sql(1.0)}),
    two AS (SELECT s.f, s.y, s.x, CAST(one.v AS DOUBLE) AS c, s.nf, CASE WHEN s.nf = s.f THEN CAST(one.v AS DOUBLE) ELSE s.s END AS s FROM s JOIN one USING (f, y, x))
    SELECT f, y, x, v FROM (WITH s AS (SELECT * FROM two), {_bilateral_sql(1.0)})""",
)(_two_pass)


#: Windows and bandwidths of the parameter sweep.
_SETTINGS = [(w, h) for w in (3, 5, 9) for h in (0.8, 1.0, 1.2)]


def _parameter_sweep(s: SparkSession, d: str) -> DataFrame:
    """Windows times bandwidths, as one long table."""
    clip, n = ad.pixels(s, d), ad.frame_count(s, d)
    made = [tm.bilateral(tm.samples(clip, n, w, 16, 16), ad.SIGMA, h).selectExpr(f"{w} AS window", f"{h}D AS h", "*") for w, h in _SETTINGS]
    return reduce(DataFrame.unionByName, made)


query(
    "parameter_sweep",
    " UNION ALL ".join(f"SELECT {w} AS window, {h}::DOUBLE AS h, f, y, x, v FROM (WITH {samples(w)}, {_bilateral_sql(h)})" for w, h in _SETTINGS).replace(" AS window,", ' AS "window",'),
)(_parameter_sweep)

# Analysis, sets and profiles ----------------------------------------------------------------------

_P8 = "preview AS (SELECT f, y, x, r >> 8 AS r, g >> 8 AS g, b >> 8 AS b FROM rgb)"
query(
    "histogram256",
    f"""WITH {RGB}, {_P8}, c AS (SELECT f, 'r' AS channel, r AS bin FROM preview UNION ALL SELECT f, 'g', g FROM preview UNION ALL SELECT f, 'b', b FROM preview UNION ALL SELECT f, 'l', (r * 2126 + g * 7152 + b * 722) // 10000 FROM preview),
    k AS (SELECT f, channel, bin, count(*) AS n FROM c GROUP BY ALL), gr AS (SELECT DISTINCT f, channel, bins.bin FROM k, (SELECT unnest(range(256)) AS bin) bins),
    h AS (SELECT f, channel, bin, coalesce(n, 0) AS n FROM gr LEFT JOIN k USING (f, channel, bin)), t AS (SELECT *, max(CASE WHEN bin BETWEEN 1 AND 254 THEN n END) OVER (PARTITION BY f, channel) AS top FROM h)
    SELECT f, channel, CAST(bin AS INT) AS bin, n, round(CASE WHEN top > 0 THEN least(1, n / top::DOUBLE) ELSE 0 END, 6) AS share FROM t""",
)(lambda s, d: col.histogram(ad.colour(s, d).selectExpr("f", "y", "x", "shiftright(r, 8) AS r", "shiftright(g, 8) AS g", "shiftright(b, 8) AS b")))
query("waveform_luma", f"WITH {RGB} SELECT f, x, CAST({duck(fm.luma('r', 'g', 'b'))} * 64 // 65536 AS INT) AS level, count(*) AS n FROM rgb GROUP BY ALL")(lambda s, d: col.waveform(ad.colour(s, d)))
query("patch_variance_top1", f"WITH {PX}, p AS (SELECT f, y // 8 AS py, x // 8 AS px, var_pop(v) AS s FROM px GROUP BY ALL) SELECT f, CAST(py AS INT) AS py, CAST(px AS INT) AS px, round(s, 4) AS variance FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY s DESC, py, px) AS rn FROM p) WHERE rn = 1")(
    lambda s, d: ad.pixels(s, d).groupBy("f", F.expr("CAST(y DIV 8 AS INT)").alias("py"), F.expr("CAST(x DIV 8 AS INT)").alias("px")).agg(F.var_pop("v").alias("s")).groupBy("f").agg(F.expr("max_by(struct(py, px, s), struct(s, -py, -px))").alias("b")).selectExpr("f", "b.py", "b.px", "round(b.s, 4) AS variance")
)
query(
    "patch_valid",
    f"""WITH {PX}, q AS (SELECT f, y // 8 AS py, x // 8 AS px, v, CASE WHEN v > 6400 THEN v - 150 ELSE v END AS w FROM px)
    SELECT f, CAST(py AS INT) AS py, CAST(px AS INT) AS px FROM q GROUP BY f, py, px HAVING avg(CASE WHEN v <= 64 OR v >= 65456 THEN 1 ELSE 0 END) <= 0.01 AND avg(CASE WHEN w <= 64 OR w >= 65456 THEN 1 ELSE 0 END) <= 0.01 AND avg(CASE WHEN v = w THEN 1 ELSE 0 END) <= 0.95 AND var_pop(v) >= 100 AND avg(v) BETWEEN 500 AND 64000""",
)(lambda s, d: valid_patches(ad.pixels(s, d).selectExpr("f", "CAST(y DIV 8 AS INT) AS py", "CAST(x DIV 8 AS INT) AS px", "v", "CASE WHEN v > 6400 THEN v - 150 ELSE v END AS w")))


def valid_patches(pairs: DataFrame) -> DataFrame:
    """Patches of noisy ``v`` and denoised ``w`` that are fit to learn from: few
    clipped, not all equal, some contrast, neither dark nor bright."""
    share = lambda e: f"avg(CASE WHEN {e} THEN 1D ELSE 0D END)"
    ok = f"{share('v <= 64 OR v >= 65456')} <= 0.01D AND {share('w <= 64 OR w >= 65456')} <= 0.01D AND {share('v = w')} <= 0.95D AND var_pop(v) >= 100D AND avg(v) BETWEEN 500D AND 64000D"
    return pairs.groupBy("f", "py", "px").agg(F.expr(ok).alias("ok")).where("ok").select("f", "py", "px")


query("segment_union", f"WITH {PX} SELECT f, y, x, v FROM px")(lambda s, d: (lambda px, n: px.where(f"f < {n // 2}").unionByName(px.where(f"f >= {n // 2}")))(ad.pixels(s, d), ad.frame_count(s, d)))
query(
    "natural_sort",
    "WITH k AS (SELECT p_partkey AS id, 'clip' || p_size || '_' || (p_partkey % 97) || '.dng' AS name, p_size AS a, p_partkey % 97 AS b FROM part) SELECT id, name, row_number() OVER (ORDER BY a, b, id) AS place FROM k",
)(lambda s, d: natural_order(ad.table(s, d, "part").selectExpr("p_partkey AS id", "concat('clip', p_size, '_', p_partkey % 97, '.dng') AS name")))


def natural_order(files: DataFrame) -> DataFrame:
    """``place`` of names whose runs of digits compare as numbers.  A listing is
    one folder's, so a single ordering is no more than its reader needs."""
    from pyspark.sql import Window

    key = "transform(regexp_extract_all(name, '(\\\\d+|\\\\D+)', 1), p -> CASE WHEN p rlike '^\\\\d' THEN lpad(regexp_replace(p, '^0+(?=\\\\d)', ''), 20, '0') ELSE p END)"
    return files.withColumn("k", F.expr(key)).select("id", "name", F.row_number().over(Window.orderBy("k", "id")).cast("long").alias("place"))


query("queue_next", "SELECT o_custkey AS worker, min(o_orderkey) AS next FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")(
    lambda s, d: ad.table(s, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("worker")).agg(F.min("o_orderkey").alias("next"))
)
_BYT = (
    "h AS (SELECT doc_id AS id, unnest(range(strlen(text))) AS pos, unnest(regexp_extract_all(hex(encode(text)), '..')) AS pair FROM documents), "
    "b AS (SELECT id, pos, 16 * (instr('0123456789ABCDEF', pair[1]) - 1) + instr('0123456789ABCDEF', pair[2]) - 1 AS v FROM h)"
)
query(
    "unpack12",
    f"WITH {_BYT}, t AS (SELECT id, pos // 3 AS g, max(CASE WHEN pos % 3 = 0 THEN v END) AS a, max(CASE WHEN pos % 3 = 1 THEN v END) AS b, max(CASE WHEN pos % 3 = 2 THEN v END) AS c, count(*) AS k FROM b GROUP BY id, pos // 3) SELECT id, CAST(g AS INT) AS g, (a << 4) | (b >> 4) AS p0, ((b & 15) << 8) | c AS p1 FROM t WHERE k = 3",
)(lambda s, d: ad.text_bytes(s, d).groupBy("id", F.expr("CAST(pos DIV 3 AS INT)").alias("g")).agg(*(F.expr(f"max(CASE WHEN pos % 3 = {i} THEN b END)").alias(c) for i, c in enumerate("abc")), F.count("*").alias("k")).where("k = 3").selectExpr("id", "g", "shiftleft(a, 4) | shiftright(b, 4) AS p0", "shiftleft(b & 15, 8) | c AS p1"))

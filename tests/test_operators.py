"""Hand-built cases of the clip operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import calibration as cal
from frameloom.operators import colour as col
from frameloom.operators import motion as mo
from frameloom.operators import spatial as sp
from frameloom.operators import temporal as tm


def clip_of(spark, frames):
    """A clip from an array of frames."""
    a = np.asarray(frames)
    return spark.createDataFrame([(int(f), int(y), int(x), int(a[f, y, x])) for f, y, x in np.ndindex(a.shape)], "f int, y int, x int, v int")


def array_of(df, shape, value="v"):
    out = np.zeros(shape, np.int64)
    for r in df.collect():
        out[r.f, r.y, r.x] = r[value]
    return out


def test_constant_clip_stays_but_for_the_bias_term(spark):
    a = np.full((5, 8, 8), 9000)
    rows = tm.samples(clip_of(spark, a), 5, 15, 8, 8)
    for name, fn in tm.TECHNIQUES.items():
        got = array_of(fn(rows, 300.0, 8, 8), a.shape)
        assert np.abs(got - a).max() <= 3, name


def test_single_frame(spark):
    a = np.random.default_rng(0).integers(0, 65536, (1, 8, 8))
    rows = tm.samples(clip_of(spark, a), 1, 15, 8, 8)
    for name in ("vst_wiener", "vst_bilateral", "inv_variance", "sigma_clip", "dct_shrink", "nlm_baseline"):
        assert (array_of(tm.TECHNIQUES[name](rows, 300.0, 8, 8), a.shape) == a).all(), name


def test_noise_falls(spark):
    a = np.clip(12_000 + np.random.default_rng(1).normal(0, 600, (9, 12, 12)), 0, 65535).astype(int)
    got = array_of(tm.bilateral(tm.samples(clip_of(spark, a), 9, 9, 12, 12), 600.0), a.shape)
    assert got[:, :10, :10].var() < 0.5 * a[:, :10, :10].var()
    assert (got[:, 10:] == a[:, 10:]).all() and (got[:, :, 10:] == a[:, :, 10:]).all()


def test_warp_snaps_to_parity_and_leaves_no_trace_outside(spark):
    a = np.arange(2 * 8 * 8).reshape(2, 8, 8)
    zero = [(0, 1, gy, gx, 0.0, 0.0) for gy in range(4) for gx in range(4)]
    away = [(1, 0, gy, gx, 40.0, 0.0) for gy in range(4) for gx in range(4)]
    flow = spark.createDataFrame(zero + away, "f int, nf int, gy int, gx int, dx double, dy double")
    rows = tm.moved_samples(clip_of(spark, a), flow, 2, 5, 8, 8).where("nf <> f").collect()
    assert {(r.y, r.x): r.s for r in rows} == {(y, x): float(a[1, y, x]) for y in range(6) for x in range(6)}


def test_windows_slide_to_stay_inside(spark):
    lows = [spark.range(10).selectExpr("CAST(id AS INT) AS f").selectExpr(tm.window_low(10, w) + " AS lo").collect() for w in (5, 99)]
    assert [r.lo for r in lows[0]] == [0, 0, 0, 1, 2, 3, 4, 5, 5, 5]
    assert [r.lo for r in lows[1]] == [0] * 10


@pytest.mark.parametrize("at,near", [((0, 0), 3), ((0, 4), 5), ((4, 4), 8)])
def test_hot_pixels(spark, at, near):
    a = np.random.default_rng(2).integers(0, 1000, (1, 8, 8))
    y, x = at
    around = sorted(int(a[0, j, i]) for j in (y - 2, y, y + 2) for i in (x - 2, x, x + 2) if (j, i) != at and 0 <= j < 8 and 0 <= i < 8)
    assert len(around) == near
    want = a.copy()
    want[0, y, x] = around[near // 2] if near % 2 else (around[near // 2 - 1] + around[near // 2]) // 2
    hot = spark.createDataFrame([at, at], "y int, x int")
    assert (array_of(cal.repair_hot(clip_of(spark, a), hot, 8, 8), a.shape) == want).all()


def test_dark_frames(spark):
    dark = spark.createDataFrame([(0, 0, 100), (0, 1, 100)], "y int, x int, v int")
    got = cal.dark_subtract(clip_of(spark, [[[116, 117, 5]]]), dark).orderBy("x").collect()
    assert [r.v for r in got] == [16, 17, 16]
    for hot, want in ((600, 0), (601, 401)):
        a = np.full((3, 8, 8), 200)
        a[:, 4, 4] = hot
        got = {(r.y, r.x): r.v for r in cal.auto_dark(clip_of(spark, a), 3, 8, 8).collect()}
        assert got[4, 4] == want and sum(got.values()) == want


def test_noise_profiles(spark):
    flat = clip_of(spark, np.full((1, 40, 40), 5000))
    row = cal.patch_profile(flat, 0, 0, 40, 40, 40, 40).first()
    assert row.valid and row.shot_gain == 0 and row.sigma == 0 and row.mean_signal == 5000
    assert not cal.patch_profile(flat, 0, 0, 31, 40, 40, 40).first().valid
    assert not cal.patch_profile(flat, 9, 9, 40, 40, 40, 40).first().valid
    ties = spark.createDataFrame([(1, 400, 1.0), (2, 800, 2.0), (3, 400, 3.0)], "ord int, iso int, sigma double")
    assert {r.ord for r in cal.nearest_profile(ties, 600).collect()} == {1, 3}


def test_block_matching_finds_a_shift(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 60_000, (40, 40))
    a = np.stack([base[4:36, 4:36], base[5:37, 2:34]])
    plane = clip_of(spark, a)
    starts = spark.createDataFrame([(1, 0, gy, gx, 0, 0) for gy in (1, 2) for gx in (1, 2)], "f int, nf int, gy int, gx int, dy int, dx int")
    found = mo.search(plane, starts, 8, 3)
    assert {(r.dy, r.dx, r.sad) for r in found.collect()} == {(1, -2, 0)}
    assert {(r.dy, r.dx) for r in mo.refine_half(plane, found, 8).collect()} == {(2, -4)}
    pairs = spark.createDataFrame([(1, 0)], "f int, nf int")
    whole = {(r.gy, r.gx): (r.dy, r.dx) for r in mo.estimate(plane, pairs, 16, 32, 32).collect()}
    assert len(whole) == 4


def test_ties_go_to_the_first_displacement(spark):
    found = mo.search(clip_of(spark, np.full((2, 8, 8), 7)), spark.createDataFrame([(1, 0, 0, 0, 0, 0)], "f int, nf int, gy int, gx int, dy int, dx int"), 4, 1).first()
    assert (found.dy, found.dx, found.sad) == (0, 0, 0)


def test_transforms_invert(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 4096, (3, 8, 8))
    plane = clip_of(spark, a)
    assert np.allclose(array_of(sp.inverse_haar(sp.haar(plane, ["f"]), ["f"]), a.shape), a)
    back = sp.dct(sp.dct(plane, ["f"]), ["f"], inverse=True).withColumn("v", F.round("v").cast("int"))
    assert (array_of(back, a.shape) == a).all()
    assert (array_of(sp.merge_subchannels(sp.subchannels(plane)), a.shape) == a).all()


def test_far_flow_without_a_near_one_is_zero(spark):
    flow = spark.createDataFrame([(0, 2, 0, 0, 3.0, 1.0), (0, 6, 0, 0, 9.0, 9.0), (0, -4, 0, 0, 5.0, 5.0)], "f int, nf int, gy int, gx int, dx double, dy double")
    got = {r.nf: (r.dx, r.dy) for r in tm.far_flow(flow).collect()}
    assert got == {2: (3.0, 1.0), 6: (9.0, 3.0), -4: (0.0, 0.0)}


def test_smoothing_over_many_frames(spark):
    values = np.random.default_rng(5).random(700)
    got = {r.f: r.s for r in tm.smoothed_flow(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "f int, avg double")).collect()}
    s = 2.0
    for i, v in enumerate(values):
        s = 0.1 * v + 0.9 * s
        assert got[i] == pytest.approx(s)


def test_interpolation_clamps(spark):
    knots = spark.createDataFrame([(100, 1.0), (200, 3.0)], "iso int, sigma double")
    asked = spark.createDataFrame([(50,), (100,), (150,), (200,), (900,)], "iso int")
    assert [r.sigma for r in col.interpolate(asked, knots, "iso", "sigma").orderBy("iso").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_first_camera_in_the_list_wins(spark):
    names = spark.createDataFrame([(1, "ACME Cam X2 Pro"), (2, "other")], "id int, name string")
    profiles = spark.createDataFrame([(2, "x2"), (1, "cam"), (3, "acme")], "ord int, pattern string")
    assert [(r.id, r.pattern) for r in col.match_camera(names, profiles).collect()] == [(1, "cam")]

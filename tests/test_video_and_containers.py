import numpy as np
import pytest

from frameloom.operators import video as vi
from frameloom.operators.kernels import apply, window_of
from frameloom.sources.containers import ber_length, movie_samples, mxf_frames, packets, scan, write_movie
from tests.test_operators import array_of, clip_of


def test_grain_is_that_of_a_running_generator(spark):
    a = np.random.default_rng(0).integers(0, 65536, (2, 4, 6))
    got, want = array_of(vi.film_grain(clip_of(spark, a), 0.5, 6, height=4, seed=7), a.shape), a.copy()
    for f in range(2):
        state = 7 + f
        for y, x in np.ndindex(4, 6):
            total = 0
            for _ in range(3):
                state = (1664525 * state + 1013904223) % 2**32
                total += (state >> 16) - 32768
            v = int(a[f, y, x])
            want[f, y, x] = min(65535, max(0, v + int(total / (32768 * 1.732) * (200 * (0.3 + 0.7 * (v / 65535))))))
    assert (got == want).all()


def test_recursion_reads_its_own_output(spark):
    a = np.clip(9000 + np.random.default_rng(1).normal(0, 700, (9, 10, 12)), 0, 65535).astype("<u2")
    frames = spark.createDataFrame([("c", f, 12, 10, a[f].tobytes()) for f in range(9)], "clip_id string, f int, width int, height int, data binary")
    got = {r.f: np.frombuffer(r.data, "<u2").reshape(10, 12) for r in vi.recursive(frames, "vst_bilateral", 600.0, window=5, tile=8).collect()}
    state = a.copy()
    for f in range(9):
        lo, w = window_of(f, 9, 5)
        state[f] = apply("vst_bilateral", state[lo : lo + w], f - lo, 600.0, 0, 0, 10, 12)
    assert all((got[f] == state[f]).all() for f in range(9))


def test_grey_survives_yuv(spark):
    rows = spark.createDataFrame([(0, 0, x, 6400 * x, 6400 * x, 6400 * x) for x in range(8)], "f int, y int, x int, r int, g int, b int")
    got = vi.rgb_to_yuv422(rows).orderBy("xc").collect()
    assert [r.cb for r in got] == [512] * 4 and [r.cr for r in got] == [512] * 4 and [r.y0 for r in got] == [6400 * x >> 6 for x in (0, 2, 4, 6)]


def test_movies_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    parts = [rng.bytes(int(n)) for n in rng.integers(1, 400, 20)]
    data = write_movie(parts, "CFHD", 64, 32)
    info = movie_samples(data)
    assert (info["codec"], info["width"], info["height"], info["timescale"]) == ("CFHD", 64, 32, 24000)
    assert [data[a : a + n] for a, n in info["samples"]] == parts
    assert movie_samples(b"\0\0\0\x08free") is None
    with pytest.raises(ValueError):
        movie_samples(b"\0\0\0\x04free" + bytes(8))
    (tmp_path / "a.mov").write_bytes(data)
    essence = bytes.fromhex("060e2b34010201010d01030115010501")
    element = lambda body: essence + b"\x83" + len(body).to_bytes(3, "big") + body
    mxf = bytes.fromhex("060e2b34020501010d01020101020400") + b"\x04abcd" + element(b"ARRI" + parts[0]) + element(b"SND " + parts[1]) + element(b"ARRI" + parts[2])
    (tmp_path / "b.mxf").write_bytes(mxf)
    assert [mxf[a : a + n] for a, n in mxf_frames(mxf)] == [b"ARRI" + parts[0], b"ARRI" + parts[2]]
    assert ber_length(b"\x05", 0) == (5, 1) and ber_length(b"\x82\x01\x00", 0) == (256, 3)
    assert scan(spark, f"file://{tmp_path}").count() == 22
    got = packets(spark, f"file://{tmp_path}/a.mov").orderBy("f").collect()
    assert [bytes(r.packet) for r in got] == parts

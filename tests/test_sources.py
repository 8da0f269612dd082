import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.sources import ari, dng, exr
from frameloom.sources import frames as fr
from frameloom.sources.bits import BitReader, BitWriter, SwitchCode, pack, signed_fold, signed_unfold, unpack
from frameloom.sources.tables import cube_table, parse_cube, parse_hot_pixels, write_hot_pixels

RNG = np.random.default_rng(1)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([10, 12, 13, 14, 16]), st.lists(st.integers(0, 1023), max_size=70), st.booleans())
def test_packed_values_round_trip(bits, values, words):
    assert unpack(pack(np.asarray(values, np.uint32), bits, little_words=words), bits, len(values), little_words=words).tolist() == values


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 6), st.integers(0, 7), st.integers(0, 7), st.lists(st.integers(-40_000, 40_000), max_size=40))
def test_switch_codes_round_trip(switch, exp, rice, values):
    if exp > rice + switch:  # the exponential part must start where the Rice part ends
        exp = rice
    code, out = SwitchCode(switch << 8 | exp << 4 | rice), BitWriter()
    for v in values:
        code.write(out, signed_fold(v))
    data = BitReader(out.done())
    assert [signed_unfold(code.read(data)) for _ in values] == values


@pytest.mark.parametrize("bits", [12, 13])
def test_ari(bits):
    a = RNG.integers(0, 65536, (34, 50)).astype(np.uint16)
    info, got = ari.decode(ari.encode(a, bits=bits, camera="Model S", exposure_index=800, wb_r=1.5))
    assert (got == a >> (16 - bits) << (16 - bits)).all() and info["camera"] == "Model S" and info["wb_r"] == 1.5 and info["bits"] == bits
    with pytest.raises(ValueError):
        ari.decode(b"ARRX" + bytes(5000))


@pytest.mark.parametrize("pattern", list(dng.SHIFTS))
def test_dng(pattern):
    a = RNG.integers(0, 65536, (12, 20)).astype(np.uint16)
    tags, got = dng.decode(dng.encode(a, camera="Cam", iso=400, pattern=pattern))
    dy, dx = dng.SHIFTS[pattern]
    want = a.copy()
    want[12 - dy :], want[:, 20 - dx :] = 0, 0
    assert (got == want).all() and tags[dng.MODEL] == "Cam" and tags[dng.ISO] == (400,)


def lossless(pixels, predictor, components=1):
    """An encoder to test against: a flat code of 16 categories."""
    counts = bytes([0, 0, 0, 0, 17] + [0] * 11)
    out = b"\xff\xd8\xff\xc4" + struct.pack(">H", 2 + 1 + 16 + 17) + b"\0" + counts + bytes(range(17))
    h, w = pixels.shape[0], pixels.shape[1] // components
    out += b"\xff\xc3" + struct.pack(">HBHHB", 8 + 3 * components, 16, h, w, components) + b"".join(bytes([c, 0x11, 0]) for c in range(components))
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * components, components) + b"".join(bytes([c, 0]) for c in range(components)) + bytes([predictor, 0, 0])
    bits, p = BitWriter(), pixels.astype(object).reshape(h, w, components)
    for y in range(h):
        for x in range(w):
            for c in range(components):
                a, b, d = (p[y, x - 1, c] if x else 0), (p[y - 1, x, c] if y else 0), (p[y - 1, x - 1, c] if x and y else 0)
                guess = 32768 if not x and not y else a if not y else b if not x else [0, a, b, d, a + b - d, a + (b - d >> 1), b + (a - d >> 1), a + b >> 1][predictor]
                diff = (p[y, x, c] - guess + 32768) % 65536 - 32768
                n = 16 if diff == -32768 else abs(diff).bit_length()
                bits.put(5, n)
                if 0 < n < 16:
                    bits.put(n, diff if diff > 0 else diff + (1 << n) - 1)
    return out + bits.done().replace(b"\xff", b"\xff\0") + b"\xff\xd9"


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_jpeg(predictor):
    a = RNG.integers(0, 65536, (9, 14)).astype(np.uint16)
    assert (dng.lossless_jpeg(lossless(a, predictor)) == a).all()
    assert (dng.lossless_jpeg(lossless(a, predictor, 2)) == a).all()


def test_exr():
    a = RNG.integers(0, 65536, (5, 7, 3))
    assert np.allclose(exr.decode(exr.encode(a)), a / 65535, atol=1e-3)


def test_tables(spark):
    cube = parse_cube('# x\nTITLE "Warm"\nLUT_3D_SIZE 2\nDOMAIN_MAX 1 1 2\n' + "\n".join("0.5 0 1" for _ in range(8)))
    assert cube["title"] == "Warm" and cube["kind"] == "3D" and cube["high"] == (1, 1, 2) and cube_table(spark, cube).count() == 8
    assert parse_cube("LUT_1D_SIZE 3\n0 0 0\n1 1 1")["kind"] == ""
    data = write_hot_pixels(8, 8, [(400, [(1, 2)]), (800, [(3, 4), (5, 6)])])
    assert parse_hot_pixels(data) == [(0, 400, 1, 2), (1, 800, 3, 4), (1, 800, 5, 6)]
    assert parse_hot_pixels(data[:-4]) == [(0, 400, 1, 2), (1, 800, 3, 4)]


def test_clips_of_files(spark, tmp_path):
    clip = RNG.integers(0, 65536, (12, 6, 8)).astype("<u2")
    rows = spark.createDataFrame([("shot", f, 8, 6, clip[f].tobytes()) for f in range(12)], "clip_id string, f int, width int, height int, data binary")
    for kind in ("dng", "ari"):
        out = f"file://{tmp_path}/{kind}"
        assert fr.write_frames(rows, out, kind) == 12
        # Numbers in names compare as numbers.
        for p in (tmp_path / kind / "shot").iterdir():
            p.rename(p.with_name(f"f{int(p.stem.split('_')[1])}.{kind}"))
        back = {r.f: np.frombuffer(r.data, "<u2").reshape(6, 8) for r in fr.read_frames(spark, out, kind).collect()}
        assert all((back[f] == (clip[f] if kind == "dng" else clip[f] >> 4 << 4)).all() for f in range(12)) and len(back) == 12
    (tmp_path / "dng" / "shot" / "f3.dng").write_bytes(b"broken")
    rest = fr.read_frames(spark, f"file://{tmp_path}/dng", "dng", skip_broken=True)
    assert [r.f for r in rest.where("data IS NULL").collect()] == [3]
    (tmp_path / "a.raw").write_bytes(clip.tobytes())
    assert [bytes(r.data) for r in fr.read_raw(spark, f"file://{tmp_path}/a.raw", 8, 6).orderBy("f").collect()] == [c.tobytes() for c in clip]
    pixels = fr.to_pixels(rows)
    assert pixels.count() == clip.size
    again = fr.from_pixels(pixels, 6, 8)
    assert {(r.f, bytes(r.data)) for r in again.collect()} == {(f, clip[f].tobytes()) for f in range(12)}
    rgb = RNG.integers(0, 65536, (3, 4, 5)).astype("<u2")
    one = spark.createDataFrame([("c", 0, 5, 4, rgb.tobytes())], rows.schema)
    assert fr.write_frames(one, f"file://{tmp_path}/exr", "exr") == 1
    assert np.allclose(exr.decode((tmp_path / "exr" / "c" / "frame_000000.exr").read_bytes()), rgb.transpose(1, 2, 0) / 65535, atol=1e-3)


def test_detection():
    assert fr.detect(b"ARRI...", "x.bin") == "ari" and fr.detect(b"II*\0", "x") == "dng"
    assert fr.detect(b"\0\0\0\x10ftypqt  CFHD", "a.mov") == "cineform" and fr.detect(b"", "a.raw") == "raw" and fr.detect(b"", "z") == ""

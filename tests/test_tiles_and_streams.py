import numpy as np
import pytest

from frameloom.operators import temporal as tm
from frameloom.operators.kernels import KERNELS
from frameloom.operators.tiles import denoise
from frameloom.sources.frames import to_pixels
from frameloom.streaming.sliding import denoise_stream

FRAME = "clip_id string, f int, width int, height int, data binary"


def clip(n, seed, h=10, w=14):
    return np.clip(9000 + np.random.default_rng(seed).normal(0, 700, (n, h, w)), 0, 65535).astype("<u2")


def rows(name, a):
    return [(name, f, a.shape[2], a.shape[1], a[f].tobytes()) for f in range(len(a))]


@pytest.mark.parametrize("name", list(KERNELS))
def test_tiles_equal_the_relational_form(spark, name):
    a = clip(23, 1)
    frames = spark.createDataFrame(rows("c", a), FRAME)
    got = np.stack([np.frombuffer(r.data, "<u2").reshape(10, 14) for r in denoise(frames, name, 616.0, window=7, tile=8, chunk=4).orderBy("f").collect()])
    samples = tm.samples(to_pixels(frames).drop("clip_id"), 23, 7, 10, 14)
    want = np.zeros(a.shape, int)
    for r in tm.TECHNIQUES[name](samples, 616.0, 10, 14).collect():
        want[r.f, r.y, r.x] = r.v
    assert got.shape == a.shape and (got == want).all()


def test_clips_of_several_lengths(spark):
    clips = {"one": clip(1, 2), "few": clip(4, 3), "many": clip(40, 4)}
    frames = spark.createDataFrame([r for k, a in clips.items() for r in rows(k, a)], FRAME)
    got = denoise(frames, "vst_bilateral", 616.0, window=15, chunk=8)
    assert {(r.clip_id, r.f) for r in got.collect()} == {(k, f) for k, a in clips.items() for f in range(len(a))}
    assert denoise(frames.limit(0), "vst_bilateral", 616.0).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    clips = {"one": clip(1, 5), "few": clip(4, 6), "many": clip(24, 7)}
    frames = spark.createDataFrame([r for k, a in clips.items() for r in rows(k, a)], FRAME)
    want = {(r.clip_id, r.f): bytes(r.data) for r in denoise(frames, "vst_bilateral", 616.0, window=7).collect()}
    schema = FRAME + ", last boolean"
    # Files arrive one after another; within a file frames are shuffled.
    for i in range(4):
        part = [(*r, r[1] == len(a) - 1) for k, a in clips.items() for r in rows(k, a)[i * len(a) // 4 : (i + 1) * len(a) // 4]]
        np.random.default_rng(i).shuffle(part)
        spark.createDataFrame([(k, int(f), int(w), int(h), d, last in (True, "True")) for k, f, w, h, d, last in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = denoise_stream(stream, "vst_bilateral", 616.0, window=7).writeStream.format("memory").queryName("denoised").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.clip_id, r.f): bytes(r.data) for r in spark.table("denoised").collect()}
    assert got == want

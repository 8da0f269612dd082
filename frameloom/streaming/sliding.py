"""A sliding temporal filter over a stream of frames.

State, for each clip: the frames that a window still needs, and the next frame
to emit.  A frame is emitted once the last frame of its window has come, half a
window late; the row that is marked as the clip's last lets the rest go.
Frames may come in any order within ``patience`` of the next one expected;
frames that were emitted already are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom.operators.kernels import apply, window_of

_OUT = "clip_id string, f int, width int, height int, data binary"
_STATE = "next int, total int, width int, height int, numbers binary, blob binary"


def denoise_stream(frames: DataFrame, technique: str, sigma: float, *, window: int = 15) -> DataFrame:
    """``frames``: a stream of ``clip_id, f, width, height, data, last``.  The
    result equals that of the batch operator once a clip's last frame is in."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, total, width, height, held = 0, -1, 0, 0, {}
        if state.exists:
            nxt, total, width, height, numbers, blob = state.get
            size = width * height * 2
            held = {int(f): blob[i * size : (i + 1) * size] for i, f in enumerate(np.frombuffer(numbers, "<i4"))}
        for batch in batches:
            for row in batch.itertuples():
                width, height = int(row.width), int(row.height)
                keep_from = max(0, nxt - window)
                if row.f >= keep_from:
                    held.setdefault(int(row.f), bytes(row.data))
                if row.last:
                    total = int(row.f) + 1
        out = []
        while total < 0 or nxt < total:
            # Until the end is known, the clip is long enough not to matter.
            lo, w = window_of(nxt, total if total >= 0 else 1 << 30, window)
            if any(f not in held for f in range(lo, lo + w)):
                break
            stack = np.stack([np.frombuffer(held[f], "<u2").reshape(height, width) for f in range(lo, lo + w)])
            made = apply(technique, stack, nxt - lo, sigma, 0, 0, height, width)
            out.append((key[0], nxt, width, height, made.tobytes()))
            nxt += 1
        # At the end windows slide back by up to their length.
        held = {f: d for f, d in held.items() if f >= nxt - window}
        if total >= 0 and nxt >= total:
            held = {}
        numbers = sorted(held)
        state.update((nxt, total, width, height, np.asarray(numbers, "<i4").tobytes(), b"".join(held[f] for f in numbers)))
        yield pd.DataFrame(out, columns=["clip_id", "f", "width", "height", "data"])

    return frames.groupBy("clip_id").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def new_files(spark, path: str, kind: str, *, per_trigger: int = 100) -> DataFrame:
    """A stream of the files that appear in a folder: path, length and content."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return reader.option("pathGlobFilter", f"*.{kind}").option("maxFilesPerTrigger", per_trigger).load(path).select("path", "length", "content")

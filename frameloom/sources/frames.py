"""Clips as files, one for each frame, and frames as rows.

A frame row is ``clip_id, f, width, height, data``: 16-bit little-endian pixels,
row by row.  Files come through Spark's own reader, so any store that Spark
reads will do; a file is decoded where it is read.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ari, dng, exr

_SCHEMA = "clip_id string, f int, width int, height int, data binary"

DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {"ari": lambda b: ari.decode(b)[1], "dng": lambda b: dng.decode(b)[1]}
ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {"dng": dng.encode, "ari": ari.encode, "raw": lambda p: p.astype("<u2").tobytes()}


def detect(head: bytes, name: str) -> str:
    """A format's name by magic bytes and extension, '' if unknown."""
    end = os.path.splitext(name)[1].lower()
    if head[:4] == b"ARRI":
        return "ari"
    if head[:4] in (b"II*\0", b"MM\0*"):
        return "dng"
    if head[4:8] in (b"ftyp", b"wide", b"mdat", b"moov"):
        for code, kind in ((b"CFHD", "cineform"), (b"zraw", "zraw"), (b"brxq", "braw"), (b"aprn", "prores_raw")):
            if code in head:
                return kind
        return {".crm": "crm", ".braw": "braw"}.get(end, "mov")
    if head[:14] == bytes.fromhex("060e2b34020501010d0102010102"):
        return "mxf"
    return {".raw": "raw", ".exr": "exr", ".cube": "cube"}.get(end, "")


def natural_key(name: str = "path") -> str:
    """Runs of digits compare as numbers, whatever their leading zeros."""
    return f"transform(regexp_extract_all(lower({name}), '(\\\\d+|\\\\D+)', 1), p -> CASE WHEN p rlike '^\\\\d' THEN lpad(regexp_replace(p, '^0+(?=\\\\d)', ''), 20, '0') ELSE p END)"


def read_frames(spark: SparkSession, path: str, kind: str, *, skip_broken: bool = False) -> DataFrame:
    """Frames of all folders below ``path``: a folder is a clip, and its files'
    natural order numbers the frames.

    Numbering lists files without reading them.  A broken file fails the job, or
    gives a frame without data if ``skip_broken``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").load(path)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    order = Window.partitionBy("clip_id").orderBy(F.expr(natural_key()), "path")
    numbers = files.select("path", folder.alias("clip_id")).withColumn("f", (F.row_number().over(order) - 1).cast("int"))
    decode = DECODERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a frame at a time: they are large
                try:
                    pixels = decode(batch.column(1)[i].as_py())
                except (ValueError, IndexError, KeyError):
                    if not skip_broken:
                        raise
                    pixels = None
                shape = pixels.shape if pixels is not None else (None, None)
                data = pixels.astype("<u2").tobytes() if pixels is not None else None
                yield pa.RecordBatch.from_pydict({"path": batch.column(0).slice(i, 1), "width": pa.array([shape[1]], pa.int32()), "height": pa.array([shape[0]], pa.int32()), "data": pa.array([data], pa.binary())})

    decoded = files.select("path", "content").mapInArrow(run, "path string, width int, height int, data binary")
    return decoded.join(numbers, "path").select("clip_id", "f", "width", "height", "data")


def read_raw(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Headerless 16-bit dumps: every file a clip, frames one after another."""
    size = width * height * 2
    files = spark.read.format("binaryFile").load(path)
    cut = files.select(F.col("path").alias("clip_id"), "content", F.explode(F.expr(f"sequence(0, CAST(length DIV {size} AS INT) - 1)")).alias("f"))
    return cut.where("f >= 0").selectExpr("clip_id", "f", f"{width} AS width", f"{height} AS height", f"substring(content, f * {size} + 1, {size}) AS data")


def write_frames(frames: DataFrame, out_dir: str, kind: str) -> int:
    """One file a frame, in a folder for each clip; returns how many.

    ``out_dir`` is a URI that all executors share.  A file gets its name when it
    is whole, so a task that runs again does no harm.
    """
    encode = ENCODERS.get(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for clip, f, width, height, data in zip(*(c.to_pylist() for c in batch.columns)):
                folder = f"{root}/{os.path.basename(clip.rstrip('/')) or 'clip'}"
                fs.create_dir(folder, recursive=True)
                pixels = np.frombuffer(data, "<u2")
                made = exr.encode(pixels.reshape(3, height, width).transpose(1, 2, 0)) if kind == "exr" else encode(pixels.reshape(height, width))
                name = f"{folder}/frame_{f:06d}.{kind}"
                with fs.open_output_stream(f"{name}.{os.getpid()}.tmp") as out:
                    out.write(made)
                fs.move(f"{name}.{os.getpid()}.tmp", name)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return frames.select("clip_id", "f", "width", "height", "data").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def to_pixels(frames: DataFrame) -> DataFrame:
    """``clip_id, f, y, x, v``: for small frames and for checks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for clip, f, width, height, data in zip(*(c.to_pylist() for c in batch.columns)):
                y, x = np.indices((height, width), dtype=np.int32)
                n = height * width
                yield pa.RecordBatch.from_pydict({"clip_id": pa.array([clip] * n, pa.string()), "f": pa.array(np.full(n, f, np.int32)), "y": pa.array(y.ravel()), "x": pa.array(x.ravel()), "v": pa.array(np.frombuffer(data, "<u2").astype(np.int32))})

    return frames.where("data IS NOT NULL").select("clip_id", "f", "width", "height", "data").mapInArrow(run, "clip_id string, f int, y int, x int, v int")


def from_pixels(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Frames of complete pixel sets; a frame must fit a task."""
    packed = F.expr("array_sort(collect_list(struct(y, x, v)))")
    grouped = pixels.groupBy("clip_id", "f").agg(packed.alias("p")).where(F.size("p") == height * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2)
            data = [np.asarray(values[i].as_py(), dtype="<u2").tobytes() for i in range(batch.num_rows)]
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict({"clip_id": batch.column(0), "f": batch.column(1), "width": pa.array([width] * n, pa.int32()), "height": pa.array([height] * n, pa.int32()), "data": pa.array(data, pa.binary())})

    return grouped.select("clip_id", "f", F.expr("transform(p, q -> q.v)").alias("v")).mapInArrow(run, _SCHEMA)

"""Token-id files: flat unsigned integers plus 64-bit document offsets.

A data set is a folder of shards.  Shard ``k`` has

* ``tokens-k.bin``: the ids of its documents, one after another, as
  little-endian unsigned integers of 16 bits (32 if the vocabulary needs it);
* ``tokens-k.idx``: ``n_docs + 1`` little-endian 64-bit offsets into it, in ids;
* ``tokens-k.key``: ``n_docs`` little-endian 64-bit document ids;
* ``tokens-k.nul``: ``n_docs`` bytes, 1 where the document id is null.

``manifest.json`` lists the shards with their bases: the prefix sums of their
token counts.  Base plus offset is a document's place in the whole data set.
Shards hold ascending, disjoint ranges of document ids.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import id_dtype, worker_bpe
from .common import shuffle_partitions

#: Bytes of ids in one Arrow batch that a reader hands on.
_READ_BYTES = 8 << 20


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", bounds: list[float] | None = None) -> DataFrame:
    """``id_col``, ``ids`` (packed, with ``end_id`` last), ``shard`` by ``bounds``.

    Null and empty texts give the end id alone.
    """
    dtype = id_dtype(tokenizer).str
    edges = np.asarray(bounds or [], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(tokenizer, dtype)
        end = np.asarray([end_id], dtype=dtype).tobytes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 1000):
                part = keys.slice(at, 1000)
                ids = [bpe.encode(x) + end for x in texts.slice(at, 1000).to_pylist()]
                place = part.cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                shard = np.searchsorted(edges, place, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([part, pa.array(ids, pa.binary()), pa.array(shard)], names=["doc_id", "ids", "shard"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids binary, shard int")


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> dict:
    """Encode ``docs`` and write them in ascending order of ``id_col``.

    ``out_dir`` is a URI that driver and executors share.  Rows without an id
    come first; rows that repeat an id follow each other, ordered by their ids.
    An empty table gives a data set of empty shards.  A shard is written under a
    name of its own attempt and then renamed, so retries never mix.  Only the
    manifest, one row for each shard, comes to the driver.
    """
    spark = docs.sparkSession
    n = shards or shuffle_partitions(spark)
    dtype = id_dtype(tokenizer)
    keys = docs.select(F.col(id_col).cast("long").alias("k")).where("k IS NOT NULL")
    bounds = keys.approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    encoded = encode_documents(docs, tokenizer, end_id, id_col=id_col, text_col=text_col, bounds=bounds)
    width = dtype.itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(out_dir)
        fs.create_dir(root, recursive=True)
        attempt = f"{task.taskAttemptId()}-{os.getpid()}"
        shard = task.partitionId()
        temp = f"{root}/_{shard:05d}-{attempt}"
        sizes, found, nulls = [], [], []
        with fs.open_output_stream(f"{temp}.bin") as out:
            for batch in batches:
                ids = batch.column(1)
                out.write(b"".join(ids.to_pylist()))
                sizes.append(np.diff(np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)) // width)
                found.append(batch.column(0).fill_null(0).to_numpy())
                nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        offsets = np.concatenate([[0], np.cumsum(join(sizes, np.int64))]).astype("<i8")
        for end, data in (("idx", offsets), ("key", join(found, "<i8")), ("nul", join(nulls, "u1"))):
            with fs.open_output_stream(f"{temp}.{end}") as out:
                out.write(data.tobytes())
        for end in ("bin", "idx", "key", "nul"):
            fs.move(f"{temp}.{end}", f"{root}/tokens-{shard:05d}.{end}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(offsets) - 1], pa.int64()), "n_tokens": pa.array([int(offsets[-1])], pa.int64())})

    placed = encoded.repartitionById(n, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids").select("doc_id", "ids")
    rows = sorted(placed.mapInArrow(write, "shard int, n_docs long, n_tokens long").collect())
    bases = np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])]).tolist()
    manifest = {"dtype": dtype.str, "tokenizer_end_id": end_id, "shards": [{"shard": r.shard, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "base": b} for r, b in zip(rows, bases)]}
    fs, root = pafs.FileSystem.from_uri(out_dir)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def _open(fs: pafs.FileSystem, path: str, dtype) -> np.ndarray:
    """The file as an array: mapped where it is local or mounted, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read_token_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids`` (little-endian 32-bit)."""
    fs, root = pafs.FileSystem.from_uri(out_dir)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    bases = {s["shard"]: s["base"] for s in manifest["shards"]}
    dtype, n = manifest["dtype"], max(1, len(bases))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                if shard not in bases:
                    continue
                name = f"{root}/tokens-{shard:05d}"
                tokens, offsets = _open(fs, f"{name}.bin", dtype), _open(fs, f"{name}.idx", "<i8")
                keys, nulls = _open(fs, f"{name}.key", "<i8"), _open(fs, f"{name}.nul", "u1")
                at, last = 0, len(keys)
                while at < last:
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _READ_BYTES // 4, side="right")) - 1)
                    ids = tokens[offsets[at] : offsets[to]].astype("<u4")
                    cuts = ((offsets[at : to + 1] - offsets[at]) * 4).astype(np.int64)
                    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(ids.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(keys[at:to]), mask=np.asarray(nulls[at:to], dtype=bool)),
                            pa.array(bases[shard] + np.asarray(offsets[at:to])),
                            pa.array(np.diff(offsets[at : to + 1])),
                            packed.cast(pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    at = to

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return spark.range(0, n, 1, n).mapInArrow(read, schema)

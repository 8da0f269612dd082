"""Helpers shared by the training-data operators.

Everything durable goes to one shared folder, so a lost executor costs a
re-read and never an answer.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    ``spark.checkpoint.dir`` names it.  Where it is unset, a temporary folder
    serves in local mode, where all tasks run on one machine; a cluster without
    it is refused, since executors would write to disks of their own.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or None
    if root is None:
        if not sc.master.startswith("local") or "cluster" in sc.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/frameloom-shared"
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/frameloom-{sc.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


#: Whether a query's shuffle files go as it ends, not at some later garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage: what follows never recomputes what came before.  Hence the
    write's shuffle files are deleted at once: they don't add to those that follow.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_partitions(spark: SparkSession, size: int, each: int = 512 << 20) -> int:
    """Partitions for ``size`` bytes: those of the session, and in large tables as
    many as hold about ``each`` bytes."""
    return max(shuffle_partitions(spark), min(200_000, -(-size // each)))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (null ids: fold of '')."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEPT: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: one thing at a time, so that the
    caches of one operator don't add to the next one's."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def trim() -> None:
    """Gives memory that this worker no longer uses back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def forget() -> None:
    """Drops what an operator before has kept in this worker."""
    _KEPT.clear()
    trim()


def text_slices(texts: pa.Array, most: int) -> Iterator[list[str | None]]:
    """The texts as Python strings, some ``most`` bytes at a time."""
    step = max(1, len(texts) * most // max(1, texts.nbytes))
    for at in range(0, len(texts), step):
        yield texts.slice(at, step).to_pylist()

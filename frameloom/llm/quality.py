"""Quality scores from gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit
from .common import forget
from .textstats import NAMES, Statistics

#: Labelled rows that a model is fitted on, at most: those with the smallest
#: hashes of their ids.  Their statistics are what the driver holds.
FIT_ROWS = 20_000


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    stats = Statistics()
    for batch in batches:
        x = stats.of(batch.column(1))
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([values, batch.column(2)], names=["x", "y"])


def fit_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", where: Column | None = None, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", **options) -> Forest:
    """A model of ``label_col`` (0 or 1) from the labelled documents.

    ``where`` narrows the label rows.  Null labels and ids don't count; several
    labels of one document are averaged, a half counts as 1.  Labels without a
    document are ignored.  Without any, or with one class, scores are constant.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known if where is None else known.where(where)
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    chosen = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    rows = chosen.join(F.broadcast(known), "__id").select("__id", "__text", "__y").mapInArrow(_features, "x array<float>, y double").toArrow()
    x = rows.column("x").combine_chunks()
    x = np.asarray(x.flatten() if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks).flatten(), dtype=np.float32).reshape(-1, len(NAMES))
    y = rows.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the same model whatever order rows arrive in
    return fit(x[order], y[order], **options)


def score_quality(docs: DataFrame, model: Forest, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score``: how likely label 1 is.

    Null and empty texts are scored as texts without a character.  Rows that
    repeat are scored alike; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        stats = Statistics()
        for batch in batches:
            score = model.score(stats.of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: Forest, threshold: float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that score ``threshold`` or more."""
    names = docs.columns
    key, text = names.index(id_col), names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        stats = Statistics()
        for batch in batches:
            yield batch.filter(pa.array(model.score(stats.of(batch.column(text))) >= threshold))

    return docs.mapInArrow(run, docs.schema)

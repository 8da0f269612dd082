"""A training corpus from raw documents: five stages, each one operator.

Every stage takes what its predecessor kept and, but for the last, returns the
columns of ``documents``.  Between stages rows go through Parquet files in the
folder that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import queries as _queries
from frameloom.llm.common import materialize, read_table
from frameloom.llm.decontaminate import keep_clean
from frameloom.llm.near_copies import keep_one_of_each
from frameloom.llm.packing import pack
from frameloom.llm.quality import keep_quality
from frameloom.llm.repeats import cut_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    return keep_quality(docs, _queries.quality_model(spark, sf_dir), _queries.QUALITY_THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, found by SimHash over five-word shingles and
    verified at a Jaccard similarity of 0.8 or more, the document with the smallest
    id stays."""
    return keep_one_of_each(docs, threshold=0.8, shingle=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words that occurred before; documents without any
    keep their text as it is, and documents that had nothing else go."""
    return cut_repeats(docs, window=20).withColumn("n_chars", F.length("text").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    return keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 token ids; one row for each piece."""
    return pack(docs, _queries.byte_bpe_path(), end_id=1, capacity=2048)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: Fingerprints, trees and byte-pair ids are beyond SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

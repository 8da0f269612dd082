"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, fresh_path, read_table

#: Documents that score less are rejected.
QUALITY_THRESHOLD = 0.3


def byte_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), radius=3, shingle=3, seed=42)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    out = fresh_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), out, byte_bpe_path(), end_id=0)
    return read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _not_null_doc(name: str):
    return F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0) & F.col(name).isNotNull()


def quality_model(spark: SparkSession, sf_dir: str):
    """Fitted on the labels outside the held-out fold."""
    from .quality import fit_quality

    labels = read_table(spark, sf_dir, "labels")
    return fit_quality(read_table(spark, sf_dir, "documents"), labels, label_col="quality", where=_not_null_doc("quality"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    scored = score_quality(read_table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_languages, identify

    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, fit_languages(docs, where=fold(F.col("doc_id"), 4) != 2))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import build, search

    rows = read_table(spark, sf_dir, "embeddings")
    return search(build(rows, keep=21), rows.where("vec_id % 20 = 0"), k=20)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(read_table(spark, sf_dir, "documents"), byte_bpe_path(), end_id=1, capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    kept = remove_repeats(read_table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derive, responses

    made = derive(responses(read_table(spark, sf_dir, "pages")))
    return made.select(
        "page_id", "response_id", "target_uri", "payload_digest", "payload_intact", "metadata_id", "metadata_digest", "conversion_id", "conversion_digest",
        F.length("text").alias("text_chars"), F.sha2("metadata", 256).alias("metadata_sha256"), F.sha2("conversion", 256).alias("conversion_sha256"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_token_files": op2_token_files,
    "op3_quality": op3_quality,
    "op4_language_id": op4_language_id,
    "op5_nearest": op5_nearest,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_repeat_removal": op8_repeat_removal,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_decontamination": op10_decontamination,
}

#: DuckDB SQL where it can express the operator.
ORACLES: dict[str, str] = {
    "op8_repeat_removal": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
        g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(w[i:i + 19], ' ')) ORDER BY doc_id, i) AS rn FROM s),
        m AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM g WHERE rn > 1) GROUP BY doc_id),
        k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r,
                     CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
              FROM d LEFT JOIN m USING (doc_id))
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
    """,
}

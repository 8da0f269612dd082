"""Views of the test tables as clips, blocks, bytes and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Noise of the test clips, where a query takes it as given.
SIGMA = 616.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frame_count(spark: SparkSession, sf: str, side: int = 16) -> int:
    """Complete frames of ``side`` x ``side`` pixels: a count from file footers."""
    return table(spark, sf, "events").count() // (side * side)


def pixels(spark: SparkSession, sf: str, side: int = 16, complete: bool = True) -> DataFrame:
    """``f, y, x, v``: events in order of their ids, as frames."""
    area = side * side
    clip = table(spark, sf, "events").selectExpr(
        f"CAST(event_id DIV {area} AS INT) AS f",
        f"CAST((event_id % {area}) DIV {side} AS INT) AS y",
        f"CAST(event_id % {side} AS INT) AS x",
        "CAST(least(65535, greatest(0, floor(value * 100 + 0.5))) AS INT) AS v",
    )
    return clip.where(F.col("f") < frame_count(spark, sf, side)) if complete else clip


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """``clip_id, f, y, x, v``: one clip for each type of event."""
    rows = table(spark, sf, "events").selectExpr("event_type AS clip_id", "row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i", "value")
    return rows.selectExpr("clip_id", "CAST(i DIV 256 AS INT) AS f", "CAST((i % 256) DIV 16 AS INT) AS y", "CAST(i % 16 AS INT) AS x", "CAST(least(65535, greatest(0, floor(value * 100 + 0.5))) AS INT) AS v")


def colour(spark: SparkSession, sf: str) -> DataFrame:
    """``f, y, x, r, g, b``: the clip at three phases."""
    values = table(spark, sf, "events").selectExpr("event_id AS i", "CAST(least(65535, greatest(0, floor(value * 100 + 0.5))) AS INT) AS v")
    out = values.withColumnRenamed("v", "r")
    for k, name in ((1, "g"), (2, "b")):
        out = out.join(values.select((F.col("i") - k).alias("i"), F.col("v").alias(name)), "i")
    return out.selectExpr("CAST(i DIV 256 AS INT) AS f", "CAST((i % 256) DIV 16 AS INT) AS y", "CAST(i % 16 AS INT) AS x", "r", "g", "b")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """``id, y, x, v``: embeddings as 8 x 8 blocks of 12 bits."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("p", "e"))
    return rows.selectExpr("id", "CAST(p DIV 8 AS INT) AS y", "CAST(p % 8 AS INT) AS x", "CAST(floor((CAST(e AS DOUBLE) + 1) * 2048 + 0.5) AS INT) AS v")


def text_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """``id, pos, b``: the UTF-8 bytes of every text."""
    pairs = F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit(".."), F.lit(0))
    exploded = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.posexplode(pairs).alias("pos", "pair"))
    return exploded.selectExpr("id", "CAST(pos AS INT) AS pos", "CAST(conv(pair, 16, 10) AS INT) AS b")


def iso_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey AS ord", "lower(p_brand) AS pattern", "100 * p_size AS iso", "p_retailprice / 1000 AS sigma")


def hot_list(spark: SparkSession, sf: str) -> DataFrame:
    """``y, x``: the pixels of frame 0 that count as hot."""
    return table(spark, sf, "events").where("event_id < 256 AND event_id % 37 = 0").selectExpr("CAST(event_id DIV 16 AS INT) AS y", "CAST(event_id % 16 AS INT) AS x")

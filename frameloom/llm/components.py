"""Connected components by alternating large-star and small-star steps.

Every step is two aggregations with map-side combine and one equi-join per
half, so a component of any size never meets in one task: a node's neighbours
are reduced to their minimum before the shuffle, and a join on a node with many
neighbours is one that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for all linked nodes.

    ``links`` has two long columns ``a`` and ``b``; rows with a null are ignored,
    loops and repeats do no harm.  Nodes without links to others don't appear.
    Each round is written to the shared folder; the loop ends when a round
    changes nothing, which happens after about log2 of the longest path.
    """
    spark = links.sparkSession
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, path = materialize(pairs, "links")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, large_path = materialize(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        nxt, nxt_path = materialize(small.distinct(), "small-star")
        after = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(spark, path, large_path)
        pairs, path = nxt, nxt_path
        if after == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after

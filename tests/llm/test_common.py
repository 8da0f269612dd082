import time
from pathlib import Path

from pyspark.sql import functions as F

from frameloom.llm.common import materialize
from frameloom.llm.repeats import repeated_spans


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name for d in dirs for p in Path(d).rglob("shuffle_*.data")}


def left_of(spark, make):
    before = shuffle_files(spark)
    made = make()
    end = time.time() + 5
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    return left, made


def test_shuffle_files_go_when_a_table_is_written(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    rows = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    left, (table, _) = left_of(spark, lambda: materialize(rows, "counts"))
    assert not left and spark.conf.get(setting) == before
    assert table.count() == rows.count() == 7  # what was shuffled can be shuffled again
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(i, f"{text} {i}") for i in range(200)], "doc_id long, text string").repartition(3)
    left, spans = left_of(spark, lambda: repeated_spans(docs))
    assert spans.count() and len(left) <= 4 * 3  # those of the small counts that plan prefixes at most

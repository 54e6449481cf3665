"""The engine's tables as the driver's parquet tables stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import collapse_ws, is_translatable, lines


#: A table smaller than this for each core may come in fewer splits than there are cores.
SPREAD_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. A small one (by its files' size) is dealt over all cores; a large one comes in enough splits as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, d, b, text, skipped): a source and language is a book, a document a chapter, a line a block."""
    docs = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("book"), F.col("doc_id").alias("d"), F.posexplode(lines(F.col("text"))).alias("b", "line"))
    rows = docs.select("book", "d", F.col("b").cast("long").alias("b"), collapse_ws(F.col("line")).alias("text"))
    return rows.withColumn("skipped", ~is_translatable(F.col("text")))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book): the books of blocks()."""
    return read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("book")).distinct()


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, page, text): a document is a page of its source."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")

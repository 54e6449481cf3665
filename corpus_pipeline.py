"""From raw documents to packed training sequences, in stages over the operators of quire.llm.

Every stage works on all rows that the one before kept. Its result is written as Parquet in the
shared folder and read back, so lost executors never reach behind a stage.

In every stage: a null text has no words and is scored as empty; repeated rows are copies of each
other; null ids are fine; texts of any length are read whole; an empty table stays empty; extra columns
travel along under any names, those that the operators use inside included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, neardup, packing, quality, substrings
from quire.llm.common import drop, table


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars as long as the text that a stage has cut; a null text keeps what it had."""
    n: Column = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.coalesce(n, F.col("n_chars")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, predicts to be good; all, where one of the labels has no rows."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, Jaccard >= 0.8): that of the smallest id. Documents without words all stay."""
    return neardup.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeated 35-word windows cover; a document may be left with an empty text, but stays."""
    return _sized(substrings.dedup(docs))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that 10-word windows of benchmark items cover (an item of fewer words is one window); all else of a text stays."""
    return _sized(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in the packed sequences; a text without tokens is its closing id alone."""
    return packing.pack(docs)


#: (name, function): each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_of_each),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: The stages train a classifier, follow links and pack greedily: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, table(stage(spark, docs, sf_dir), name)
        if k:
            drop(before)
    return docs

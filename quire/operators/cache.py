"""Answers already there: resume logs by batch, the translation cache by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.hashing import cache_key


def latest(log: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key by seq."""
    rest = [c for c in log.columns if c not in (*key, seq)]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last")).select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def with_keys(items: DataFrame, prefix, text: str = "text") -> DataFrame:
    return items.withColumn("k", cache_key(prefix, F.col(text)))


def lookup(items: DataFrame, cache: DataFrame) -> DataFrame:
    """items (with k) and the cached answer t, null where there is none. cache has one row a key."""
    return items.join(cache.select("k", "t"), "k", "left")


def new_entries(answers: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows (k, t) that the cache does not hold with this answer yet."""
    return answers.select("k", "t").distinct().join(cache.select("k", "t"), ["k", "t"], "left_anti")


def pending(batched: DataFrame, resumed: DataFrame, key: str = "book") -> DataFrame:
    """(book, requests, done): batches that a run would send, and those that need no request.

    batched has a row an item with its key k's hit; a batch is done if the resume log has it or all
    its items are cached.
    """
    by_batch = batched.groupBy(key, "batch_id").agg(F.bool_and("hit").alias("cached"))
    marks = resumed.select(key, "batch_id").distinct().withColumn("resumed", F.lit(True))
    rows = by_batch.join(marks, [key, "batch_id"], "left").withColumn("done", F.coalesce("resumed", F.lit(False)) | F.col("cached"))
    return rows.groupBy(key).agg(F.count_if(~F.col("done")).alias("requests"), F.count_if("done").alias("done"))

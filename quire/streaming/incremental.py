"""Incremental translation: a stream of blocks, answered once each.

Each micro-batch looks its items up in the cache, calls the translator for the rest and appends the
new answers to the cache before its own output; after a restart the stream's checkpoint and the
cache together keep any item from being called twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.hashing import cache_key, cache_prefix
from quire.plans.job import Translator, translate
from quire.sources.logs import append_cache, read_cache


def translate_stream(blocks: DataFrame, model: str, language: str, instructions: str, cache_path: str, out_path: str, checkpoint: str, translator: Translator | None = None) -> StreamingQuery:
    """blocks (book, d, b, text, skipped) to Parquet (…, translation) under out_path."""
    prefix = cache_prefix(F.lit(model), F.lit(language), F.lit(instructions))

    def step(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            known = rows.select("text").distinct().withColumn("k", cache_key(prefix, F.col("text"))).join(read_cache(spark, cache_path), "k").select("text", "t")
            done = translate(rows, model, translator, cache=known).persist()
            told = done.where("translation is not null").select(cache_key(prefix, F.col("text")).alias("k"), F.col("translation").alias("t")).dropDuplicates(["k"])
            append_cache(told, cache_path, epoch)
            done.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
            done.unpersist()
        finally:
            rows.unpersist()

    return blocks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Where a job stands: joined parts, states of segments, outcome of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, translation): parts (part, n_parts, t) put together without a separator once all are there, else null."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("part", "t")))), lambda x: x["t"]), "")
    return parts.groupBy(*keys).agg(whole.alias("_t"), F.count("t").alias("_have"), F.max("n_parts").alias("_need")).select(*keys, F.when(F.col("_have") == F.col("_need"), F.col("_t")).alias("translation"))


def segment_state(done: Column, total: Column) -> Column:
    return F.when((total == 0) | (done == 0), "pending").when(done >= total, "done").otherwise("active")


def segments(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, done, total, state) over blocks (skipped, translation)."""
    rows = blocks.groupBy(*keys).agg(F.count_if(~F.col("skipped") & F.col("translation").isNotNull()).alias("done"), F.count_if(~F.col("skipped")).alias("total"))
    return rows.withColumn("state", segment_state(F.col("done"), F.col("total")))


def job_status(fatal: Column, cancelled: Column, failed: Column, batches: Column) -> Column:
    return F.when(fatal, "failed").when(cancelled, "cancelled").when((batches > 0) & (failed >= batches), "failed").when(failed > 0, "partial").otherwise("completed")


def counters(outcomes: DataFrame) -> DataFrame:
    """(done, failed, tokens, cached) over a job's items (book, batch_id, outcome, tokens, hit); batches count as done, failed ones too."""
    batches = outcomes.groupBy("book", "batch_id").agg(F.bool_and("hit").alias("whole"), F.count_if("hit").alias("hits"), F.bool_or(F.col("outcome") != "done").alias("bad"), F.sum("tokens").alias("tokens"))
    return batches.agg(F.count(F.lit(1)).alias("done"), F.count_if("bad").alias("failed"), F.coalesce(F.sum(F.when(~F.col("bad"), F.col("tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum("hits"), F.lit(0)).alias("cached"))


def usage_line(requests: Column, exhausted: Column, reset: Column) -> Column:
    """What a model's quota line says; reset is the time of day at which the quota comes back."""
    n = F.coalesce(requests, F.lit(0))
    said = F.concat(n.cast("string"), F.when(n == 1, " request").otherwise(" requests"), F.lit(" on this model today · resets "), reset)
    return F.when(F.coalesce(exhausted, F.lit(False)), F.concat(F.lit("quota exhausted for today — resets "), reset)).when(n > 0, said).otherwise(F.concat(F.lit("daily quota resets "), reset))

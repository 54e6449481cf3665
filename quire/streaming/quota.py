"""The daily quota: days that begin at 08:00 UTC, in batch and in a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY, SHIFT = 86400, 57600


def quota_day(ts: Column) -> Column:
    """The number of the quota day: it changes at 08:00 UTC."""
    return F.floor((F.unix_timestamp(ts) + SHIFT) / DAY).cast("long")


def reset_at(day: Column) -> Column:
    """Epoch second at which a quota day ends."""
    return (day + 1) * DAY - SHIFT


def usage(requests: DataFrame) -> DataFrame:
    """(day, model, requests, exhausted, reset_at) from a log of requests (ts, model, exhausted)."""
    done = requests.groupBy(quota_day(F.col("ts")).alias("day"), "model").agg(F.count(F.lit(1)).alias("requests"), F.bool_or("exhausted").alias("exhausted"))
    return done.withColumn("reset_at", reset_at(F.col("day")))


def current(usage_rows: DataFrame, now: Column) -> DataFrame:
    """Rows of the current quota day only: older days are forgotten."""
    return usage_rows.where(F.col("day") == quota_day(now))


def usage_stream(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """The same over a stream: tumbling windows of a day from 08:00 UTC; rows later than `late` are dropped."""
    rows = requests.withWatermark("ts", late)
    day = F.window("ts", "1 day", "1 day", "8 hours")
    done = rows.groupBy(day.alias("w"), "model").agg(F.count(F.lit(1)).alias("requests"), F.max(F.col("exhausted").cast("int")).alias("e"))
    return done.select(quota_day(F.col("w.start")).alias("day"), "model", "requests", (F.col("e") == 1).alias("exhausted"))

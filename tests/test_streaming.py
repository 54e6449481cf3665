import datetime as dt

from pyspark.sql import functions as F

from quire.streaming import incremental, quota


def test_quota_day_changes_at_eight(spark):
    at = [dt.datetime(2026, 1, 1, 0, 0), dt.datetime(2026, 1, 1, 7, 59, 59), dt.datetime(2026, 1, 1, 8, 0)]
    days = [r[0] for r in spark.createDataFrame([(t,) for t in at], "ts timestamp").select(quota.quota_day(F.col("ts"))).collect()]
    assert days[0] == days[1] == days[2] - 1


def test_usage_rolls_over(spark):
    rows = [(dt.datetime(2026, 1, 1, 9), "m", False), (dt.datetime(2026, 1, 2, 7), "m", True), (dt.datetime(2025, 12, 30), "m", False)]
    used = quota.usage(spark.createDataFrame(rows, "ts timestamp, model string, exhausted boolean"))
    now = quota.current(used, F.lit(dt.datetime(2026, 1, 2, 7, 30)))
    assert [(r["requests"], r["exhausted"]) for r in now.collect()] == [(2, True)]
    assert quota.current(used, F.lit(dt.datetime(2026, 1, 3, 9))).count() == 0


def test_usage_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 1 + i // 24, i % 24), f"m{i % 3}", i % 7 == 0) for i in range(72)]
    src = str(tmp_path / "log")
    df = spark.createDataFrame(rows, "ts timestamp, model string, exhausted boolean")
    df.repartition(3).write.parquet(src)
    stream = quota.usage_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), "30 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("used").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("used").collect()}
    assert got == {tuple(r) for r in quota.usage(df).drop("reset_at").collect()}


def test_blocks_are_answered_once(spark, tmp_path):
    src, calls = str(tmp_path / "in"), f"{tmp_path}/calls"
    rows = [("k", 0, i, f"line number {i % 5}", False) for i in range(10)] + [("k", 0, 10, "42", True)]
    df = spark.createDataFrame(rows, "book string, d long, b long, text string, skipped boolean")
    df.coalesce(1).write.parquet(src)

    def counting(model, items):
        with open(calls, "a") as f:
            f.writelines(t + "\n" for _, t in items)
        return "ok", [(i, t.upper()) for i, t in items], 1

    def go():
        stream = spark.readStream.schema(df.schema).parquet(src)
        incremental.translate_stream(stream, "x-lite", "Thai", "", f"file://{tmp_path}/cache", f"file://{tmp_path}/out", f"file://{tmp_path}/check", counting).awaitTermination(120)

    go()
    df.withColumn("b", F.col("b") + 100).coalesce(1).write.mode("append").parquet(src)
    go()
    out = spark.read.parquet(f"file://{tmp_path}/out").where("not skipped")
    assert out.count() == 20 and out.where(F.col("translation") != F.upper("text")).count() == 0
    assert len(open(calls).read().splitlines()) <= 20
    assert set(open(calls).read().splitlines()) == {f"line number {i}" for i in range(5)}

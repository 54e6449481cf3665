"""Line logs: resume logs, the translation cache, daily usage, settings.

Lines carry a seq, since files have no order in Spark; of rows with one key the last by seq counts.
Lines that are no such JSON are skipped.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.cache import latest, new_entries


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return spark.createDataFrame([], f"v struct<{schema}>")
    return spark.read.text(path).select(F.from_json("value", f"struct<{schema}>").alias("v")).where("v is not null")


def read_resume(spark: SparkSession, path: str) -> DataFrame:
    """(i, item, t): the last line of each batch with answers; item numbers that are none are dropped."""
    rows = _lines(spark, path, "i:bigint,t:map<string,string>,seq:bigint").select("v.*").where("i >= 0 and size(t) > 0")
    last = latest(rows.withColumn("seq", F.coalesce("seq", F.lit(0))), ["i"])
    items = last.select("i", F.explode("t").alias("item", "t")).where("t is not null")
    return items.select("i", F.expr("try_cast(item as bigint)").alias("item"), "t").where("item >= 0")


def append_resume(answers: DataFrame, path: str, seq: int) -> None:
    """A line for each batch (i) whose items are all answered, from (i, item, t)."""
    whole = answers.groupBy("i").agg(F.bool_and(F.col("t").isNotNull()).alias("full"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("item").cast("string"), "t")))).alias("t")).where("full")
    whole.select(F.to_json(F.struct("i", "t", F.lit(seq).alias("seq"))).alias("value")).write.mode("append").text(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(k, t), the last answer of each key."""
    rows = _lines(spark, path, "k:string,t:string,seq:bigint").select("v.*").where("k is not null and t is not null")
    return latest(rows.withColumn("seq", F.coalesce("seq", F.lit(0))), ["k"])


def append_cache(answers: DataFrame, path: str, seq: int) -> None:
    """Lines for answers (k, t) that the cache does not hold like that yet."""
    spark = answers.sparkSession
    new = new_entries(answers, read_cache(spark, path))
    new.select(F.to_json(F.struct("k", "t", F.lit(seq).alias("seq"))).alias("value")).write.mode("append").text(path)


def clear_cache(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], "value string").write.mode("overwrite").text(path)


def cache_stats(spark: SparkSession, path: str) -> DataFrame:
    """(entries, bytes)."""
    files = spark.read.format("binaryFile").load(path).select("length") if _exists(spark, path) else spark.createDataFrame([], "length long")
    return read_cache(spark, path).agg(F.count(F.lit(1)).alias("entries")).crossJoin(files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# ---------------------------------------------------------------- settings


@dataclass
class Settings:
    api_key: str = ""
    model: str = "gemini-3.5-flash-lite"
    mode: str = "bilingual"
    custom_instructions: str = ""
    auto_switch_model: bool = True


MODES = ("bilingual", "translated")


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> str:
    jvm, p, fs = _file(spark, path)
    if not fs.exists(p):
        return ""
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_file(spark: SparkSession, path: str, text: str, private: bool = False) -> None:
    """Written whole under another name, then given its own; on any file system that Spark knows."""
    jvm, p, fs = _file(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{p.toString()}.part")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.hsync()
    stream.close()
    if private:
        fs.setPermission(part, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"could not write {path}")


def load_settings(spark: SparkSession, path: str) -> Settings:
    """Defaults where the file is absent or blank, or lacks a field; a broken file is kept aside and reported."""
    text = _read(spark, path)
    if not text.strip():
        return Settings()
    try:
        known = {f.name for f in fields(Settings)}
        return Settings(**{k: v for k, v in json.loads(text).items() if k in known})
    except (ValueError, AttributeError, TypeError) as e:
        jvm, p, fs = _file(spark, path)
        aside = f"{path.removesuffix('.json')}.broken"
        fs.rename(p, jvm.org.apache.hadoop.fs.Path(aside))
        raise ValueError(f"settings were broken and are kept in {aside}") from e


def save_settings(spark: SparkSession, settings: Settings, path: str) -> None:
    """Readable by the owner only, since they hold the key."""
    write_file(spark, path, json.dumps(asdict(settings)), private=True)


# ---------------------------------------------------------------- finished batches of jobs


BATCH = "key:string,batch_id:bigint,items:array<struct<d:bigint,b:bigint,part:int,t:string,model:string>>,seq:bigint"


def append_batches(spark: SparkSession, batches: list[dict], folder: str) -> None:
    """Lines for batches {key, batch_id, items}, in a file of their own."""
    seq = time.time_ns()
    write_file(spark, f"{folder}/{seq}-{uuid.uuid4().hex}.jsonl", "".join(json.dumps({**b, "seq": seq}, ensure_ascii=False) + "\n" for b in batches))


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """(key, batch_id, d, b, part, t): of each batch the last line that holds any item."""
    rows = _lines(spark, folder, BATCH).select("v.*").where("key is not null and batch_id >= 0 and size(items) > 0")
    return latest(rows, ["key", "batch_id"]).select("key", "batch_id", F.inline("items")).where("t is not null").drop("model")

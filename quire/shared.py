"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark removes a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a new temporary one in local mode, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, lost executors lose nothing.

    Its shuffle files are not needed once it is written, so they are released. The table goes when
    the driver's JVM ends, or with drop().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    keep = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if keep is None else spark.conf.set(_CLEANUP, keep)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(schema).parquet(path)
    out._quire_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that no later result reads."""
    for t in tables:
        fs, p = _fs(t.sparkSession, t._quire_path)
        fs.delete(p, True)

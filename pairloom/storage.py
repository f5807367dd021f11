"""Intermediate tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, a folder of our own if driver and executors are one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pairloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    The shuffle files of the write are dropped when it ends; the table is dropped by release(), or with the JVM.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with setting(spark, _CLEAN, "true"):
        df.write.option("compression", "zstd").parquet(path)
    fs, target = _path(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._pairloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Drops a table of materialize() that no later step reads."""
    path = getattr(df, "_pairloom_path", None)
    if path:
        fs, target = _path(df.sparkSession, path)
        fs.delete(target, True)

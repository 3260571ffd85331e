"""Intermediate tables in the shared folder that the session names.

A plan that is read more than once, or whose lineage grows in a loop, is written as Parquet under
``spark.checkpoint.dir`` and read again. The files are on storage that every executor sees, so a lost executor
costs a task and not the work before it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_MADE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. Only a one-JVM session without the setting gets a temporary folder."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = tempfile.mkdtemp(prefix="spark-scratch-")
    return _MADE[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used. What is there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and returns a DataFrame over the files."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished queries now, instead of when the driver next collects its garbage.

    For operators of several large steps, each of which is written before the next begins.
    """
    gc.collect()
    spark._jvm.System.gc()

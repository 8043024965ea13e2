"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach: spark.checkpoint.dir. In local mode (tests) a new one if
    that is unset; on a cluster a folder of this machine would be no use to the others, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="dossier-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/dossier/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies; at exit the session may be gone already."""
    if spark.sparkContext._jsc is None:
        return
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM has ended: nothing can be deleted through it
        return


def save(df: DataFrame, path: str) -> None:
    """Writes an intermediate table, without the empty marker file of a finished job, which nothing looks for. On a local
    file system each created file starts a process (chmod), whose memory is the JVM's until it runs."""
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of a plan as a table: worked out once, whatever is read from it, and safe from lost executors."""
    path = new_path(df.sparkSession, name)
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

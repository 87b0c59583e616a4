"""Tables cut from their lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset and the master is local, as in tests; removed when Python ends.
LOCAL = f"/tmp/checkpoints/factloom-local-{os.getpid()}"

#: For writes of scratch tables to a local file system: no checksum file beside each file. Without native code Hadoop
#: starts `chmod` four times for a file with its checksum, once for a plain one. Other file systems aren't touched by it.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return qualified(spark, root.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    atexit.register(shutil.rmtree, LOCAL, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{LOCAL}")
    return f"file://{LOCAL}"


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme: one without is of the cluster's default file system, which tasks can't ask for."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{shared_root(spark)}/factloom-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """df, written to the shared folder and read again: later steps neither repeat its work nor need its executors."""
    path = scratch_path(df.sparkSession, what)
    df.write.options(**PLAIN).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's file system, whatever its scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Frames that read them are of no use after it."""
    delete_path(spark, f"{shared_root(spark)}/factloom-{spark.sparkContext.applicationId}")

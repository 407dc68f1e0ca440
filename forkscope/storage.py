"""Intermediate tables in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends. A local session without setting gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("forkscope.local.shared", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="forkscope-shared-")
        spark.conf.set("forkscope.local.shared", folder)
    path = f"{folder.rstrip('/')}/forkscope-{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, path: str) -> None:
    """df written to path. Its shuffle files go when it is there, and neighbouring rows that are alike take little room."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(name, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once and read back: cuts its lineage, and survives lost executors."""
    path = new_path(df.sparkSession, label)
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Lowers how many rows the session's readers hold at once, for tables of whole states."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(name, str(min(int(spark.conf.get(name, "4096")), 128)))

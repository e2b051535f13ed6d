"""The shared folder in which tables that later steps need are written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, named by spark.checkpoint.dir.

    Where none is named, a session on one machine gets one of its own; a cluster is refused, since a folder
    of the driver's machine would lose the executors' rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Later steps then neither repeat the work nor depend on an executor's local files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyfold/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

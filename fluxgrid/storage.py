"""Tables in the folder that the driver and all executors share: lineage ends there, lost executors lose nothing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that ``spark.checkpoint.dir`` names.

    Where it is unset a local run (tests) gets a local temporary folder; a cluster, whose executors would each
    write to their own disk, gets an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

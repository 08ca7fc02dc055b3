"""Folder iterators as streams: each trigger takes the next files, progress is kept in a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def text_files(spark: SparkSession, folder: str, glob: str = "*.txt", files_per_trigger: int = 1) -> DataFrame:
    """path and text of the files of a folder, a few for each trigger."""
    source = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob)
    rows = source.option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def tables(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Rows of the Parquet files of a folder, a few files for each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def drained(stream: DataFrame, name: str) -> StreamingQuery:
    """Run a stream over all present files into a memory table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query

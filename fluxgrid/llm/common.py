"""Helpers shared by the text operators: word rules, inputs, shared folder, brackets for expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.storage import shared_dir

#: A word is a run of characters outside ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: The same white space as a set of characters.
WHITE = " \t\n\x0b\x0c\r"
#: Bytes of one Arrow batch, and the setting that bounds them.
BATCH_BYTES, BATCH_SETTING = "2m", "spark.sql.execution.arrow.maxBytesPerBatch"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it in ``body``; safe inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; an empty array for null or blank texts."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that other columns never clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def map_arrow(rows: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow over batches bounded by bytes: a batch of long texts must not fill a worker.

    A session that bounds its batches itself keeps its bound.
    """
    spark = rows.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return rows.mapInArrow(run, schema)


def stored(df: DataFrame, name: str, codec: str = "zstd", **options: str) -> DataFrame:
    """Write a table in the shared folder and read it again: lineage ends here, lost executors lose nothing."""
    path = store(df, name, codec, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df: DataFrame, name: str, codec: str = "zstd", **options: str) -> str:
    """Write a table in the shared folder; its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression=codec, **options).parquet(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

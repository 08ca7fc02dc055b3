"""Corpus pipeline: five stages from documents to token ids, each written as Parquet and read again.

Each stage works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import bpe, mixing, pii, rule_classifier, simhash
from fluxgrid.llm.common import documents, stored
from fluxgrid.llm.queries import MIX, QUALITY_THRESHOLD, pseudonym_key, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    model = rule_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_classifier.keep(docs, model, QUALITY_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal data; n_chars follows the text."""
    out = pii.pseudonymise(docs, pseudonym_key(spark))
    if "n_chars" not in out.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.select(
        *[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the weights of their sources; no document is left out, small sources repeat."""
    return mixing.mix_rows(docs, MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn document, with digests of the ids and of the decoded text."""
    return bpe.round_trip(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII pseudonyms", pseudonyms),
    ("mixing sources", mix),
    ("BPE encoding", tokens),
]

#: SQL can't express the classifier, the fingerprints or the coder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs

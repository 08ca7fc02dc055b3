"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import (
    bpe,
    licences,
    media_ogg,
    mixing,
    pii,
    quality_rules,
    rule_classifier,
    simhash,
    substring_dedup,
    token_output,
)
from fluxgrid.llm.common import documents, stored

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of the default rule table for every document."""
    return quality_rules.apply_rules(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op1_sql() -> str:
    """The same in SQL, from the rule table."""
    broken = []
    for r in quality_rules.DEFAULT_RULES:
        broken += [f"{r.stat} < {r.low}"] * (r.low is not None) + [f"{r.stat} > {r.high}"] * (r.high is not None)
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    return rf"""
    WITH base AS (
      SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rid, coalesce(text, '') AS text FROM documents
    ), parts AS (
      SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base
    ), spots AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM parts WHERE len(words) >= 3
    ), win AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM spots
    ), twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1
    ), covered AS (
      SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
    ), counts AS (
      SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda w: lower(w) IN ({stop})))::BIGINT AS n_stop_words
      FROM parts LEFT JOIN covered USING (rid)
    ), ratios AS (
      SELECT *, n_symbols / greatest(n_words, 1) AS symbol_ratio, n_stop_words / greatest(n_words, 1) AS stop_ratio,
        n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, word_chars / greatest(n_words, 1) AS mean_word_chars,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND NOT ({" OR ".join(broken)}) AS kept
    FROM ratios"""


#: Mix of the pipeline: 99 % of the largest entropy unless a source would be read more than twice; none is cut.
MIX = mixing.Mix()
#: Mix of the query: 99.99 % of the largest entropy unless a source would be read more than four times, in blocks of
#: 5,000 tokens; the largest source is read once and none is cut, so small ones repeat as often as evenness asks.
EVEN_MIX = mixing.Mix(entropy=0.9999, repeats=4.0, block=5_000)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is drawn, with the weights of its source."""
    return mixing.drawn(documents(spark, sf_dir).select("doc_id", "text", "source"), EVEN_MIX).select(
        "doc.doc_id",
        "doc.source",
        F.round("share", 6).alias("share"),
        F.round("weight", 6).alias("weight"),
        F.round("epochs", 6).alias("epochs"),
        "n_copies",
    )


def tokenizer_path() -> str:
    """Place of the public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path())


#: A document is kept when its score reaches this.
QUALITY_THRESHOLD = 0.3


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by rules learnt from the rows that are not held out."""
    docs = documents(spark, sf_dir)
    model = rule_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_classifier.score(docs, model).select(
        "doc_id",
        (rule_classifier.fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def op6_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an Ogg medium in a stored table, read back from there."""
    return media_ogg.features(stored(media_ogg.store_texts(documents(spark, sf_dir)), "media"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written in order of doc_id, then read back."""
    return token_output.index(spark, token_output.write(documents(spark, sf_dir), tokenizer_path()))


#: Session setting of the key of pseudonyms, and the key of runs without it (tests and checks, no secret).
PII_KEY_SETTING, TRIAL_KEY = "spark.fluxgrid.pseudonym.key", "trial-key"


def pseudonym_key(spark: SparkSession) -> str:
    """Key of pseudonyms as the session names it."""
    return spark.conf.get(PII_KEY_SETTING, TRIAL_KEY)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms, and how many values of each kind were replaced."""
    docs = documents(spark, sf_dir).select("doc_id", "text", pii.kinds(F.col("text")).alias("kinds"))
    return docs.select("doc_id", pii.masked(F.col("text"), pseudonym_key(spark)).alias("text"), *pii.counts(F.col("kinds")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id"
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated passages leave of every document."""
    return substring_dedup.removed(documents(spark, sf_dir))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of whole texts and single lines of every document."""
    return licences.scan(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_bpe": op3_bpe,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_pii": op5_pii,
    "op6_media_ogg": op6_media_ogg,
    "op7_token_output": op7_token_output,
    "op8_simhash": op8_simhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_licences": op10_licences,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": op1_sql(),
    "op2_mixing": mixing.sql(EVEN_MIX),
    "op10_licences": licences.sql(),
}

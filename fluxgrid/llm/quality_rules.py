"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Cases: a null text counts as empty; an empty text has no words, so every ratio is null-safe zero and the
length rule rejects it; very long texts are read whole; repeated rows get equal results; extra columns of
the input are ignored; an empty table gives an empty result.  Three-word windows are compared by hash first,
then by their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm.common import WHITE, id_text, let, words_of

SYMBOL_SET = "[#*$%&|<>]"

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are with as be this by from or at "
    "der die das und ist von den mit im des auf für ein eine nicht zu dem sich auch als "
    "le la les et de des un une est en que qui du dans pour sur par au pas avec "
    "el los las y del por con para una se lo como más su al no"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when ``stat`` is below ``low`` or above ``high``."""

    name: str
    stat: str
    low: float | None = None
    high: float | None = None


#: Names refer to statistics and ratios of :func:`statistics`.
DEFAULT_RULES = (
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("dup_lines", "dup_line_ratio", high=0.4),
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
)
#: The base rule is fixed: few words, or over half of the words in repeated three-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def repeated_words(words: Column) -> Column:
    """Number of words inside three-word windows that occur twice or more; ``words`` must be cheap to evaluate.

    Windows are sorted as longs: the lower bits, as many as positions need, are the position of the
    window, the upper ones its hash.  Neighbours with equal upper bits count once their words prove equal.
    """
    n = F.size(words)
    bits = F.length(F.bin(n))

    def keys(b: Column) -> Column:
        return F.transform(
            F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))),
            lambda w, i: F.call_function("shiftleft", F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), b) + i,
        )

    def covered(s: Column, low: Column) -> Column:
        place = lambda v: v.bitwiseAND(low).cast("int")
        word = lambda v, k: F.get(words, place(v) + k)
        # element by element: a slice would copy the whole array for each pair
        equal = lambda v, o: (word(v, 0) == word(o, 0)) & (word(v, 1) == word(o, 1)) & (word(v, 2) == word(o, 2))
        # neighbours that differ in low bits only
        pairs = F.filter(
            F.zip_with(
                s,
                F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))),
                lambda v, other: F.when(v.bitwiseXOR(other).between(0, low), F.array(v, other)),
            ),
            lambda pair: pair.isNotNull(),
        )
        twice = F.array_distinct(F.flatten(F.filter(pairs, lambda pair: equal(pair[0], pair[1]))))
        # a window at p adds the words that the window before it does not hold
        return F.aggregate(
            F.sort_array(F.transform(twice, place)),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    found = let(
        F.struct(bits.alias("bits"), (F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).alias("low")),
        lambda b: let(F.sort_array(keys(b["bits"])), lambda s: covered(s, b["low"])),
    )
    return F.when(n < 3, F.lit(0)).otherwise(found)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics that rules can name: counts (long) and ratios (double)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = id_text(docs, id_col, text_col).select(
        "doc_id",
        words_of(F.col("text")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("lines"),
    )
    words, lines = F.col("words"), F.col("lines")
    counts = parts.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.array_join(words, "").alias("dense"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    dense = F.col("dense")
    counts = counts.select(
        "doc_id",
        "n_words",
        F.length(dense).cast("long").alias("word_chars"),
        F.regexp_count(dense, F.lit(SYMBOL_SET)).cast("long").alias("n_symbols"),
        "n_lines",
        "n_dup_lines",
        "n_repeat_words",
        "n_stop_words",
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counts.select(
        "*",
        per("n_symbols", "n_words").alias("symbol_ratio"),
        per("n_stop_words", "n_words").alias("stop_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"),
    )


def failed(rule: Rule) -> Column:
    """True where a rule is broken."""
    stat, out = F.col(rule.stat), F.lit(False)
    if rule.low is not None:
        out = out | (stat < F.lit(rule.low))
    if rule.high is not None:
        out = out | (stat > F.lit(rule.high))
    return out


def apply_rules(docs: DataFrame, rules=DEFAULT_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: statistics, base_failed, failed_rules (names joined by comma), kept."""
    stats = statistics(docs, id_col, text_col)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    names = F.array_compact(F.array(*[F.when(failed(r), F.lit(r.name)) for r in rules]))
    return stats.select(
        "*", base.alias("base_failed"), F.array_join(names, ",").alias("failed_rules")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))

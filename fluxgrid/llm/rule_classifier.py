"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Shallow trees are boosted on a bounded sample of labelled statistics; every path of a tree becomes a
conjunctive rule; a lasso logistic regression over the rules keeps a few of them; the kept rules become one
column expression, so scoring is a plain projection.

Cases: null and empty texts have zero statistics and get a score like any other; null labels and labels
without a document are not learnt from; repeated label rows count once; very long texts are measured whole;
other columns are ignored; without both labels in the sample every score is the prior; an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm.common import WHITE, id_text, words_of
from fluxgrid.llm.quality_rules import STOP_WORDS

#: Most labelled rows that a fit reads, the first by a hash of their ids.
MAX_SAMPLE = 8_000
STATS = (
    "n_words",
    "mean_word_chars",
    "symbol_ratio",
    "stop_ratio",
    "dup_line_ratio",
    "distinct_word_ratio",
    "distinct_triple_ratio",
    "upper_ratio",
    "mark_ratio",
    "digit_ratio",
    "words_per_line",
)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS as doubles, without user functions."""
    return with_statistics(id_text(docs, id_col, text_col), "text").select("doc_id", *[stat(s).alias(s) for s in STATS])


#: Columns that with_statistics adds; the prefix keeps them apart from input columns.
PREFIX = "__rule_"


def stat(name: str) -> Column:
    """A statistic added by with_statistics."""
    return F.col(PREFIX + name)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All input columns and the statistics under their prefix."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hidden = lambda name: PREFIX + name
    parts = docs.select(
        "*",
        words_of(F.col(text_col)).alias(hidden("words")),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias(hidden("lines")),
    )
    words, lines = stat("words"), stat("lines")
    counts = parts.withColumns(
        {
            hidden("n_words"): F.size(words).cast("double"),
            hidden("dense"): F.array_join(words, ""),
            hidden("triples"): F.transform(
                words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
            ),
            hidden("n_distinct"): F.size(F.array_distinct(words)),
            hidden("n_stop"): F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
            hidden("n_lines"): F.size(lines),
            hidden("n_distinct_lines"): F.size(F.array_distinct(lines)),
        }
    )
    dense, n = stat("dense"), F.greatest(stat("n_words"), F.lit(1.0))
    chars = F.greatest(F.length(dense), F.lit(1))
    per_char = lambda what: F.regexp_count(dense, F.lit(what)) / chars
    return counts.withColumns(
        {
            hidden("mean_word_chars"): F.length(dense) / n,
            hidden("symbol_ratio"): F.regexp_count(dense, F.lit("[#*$%&|<>]")) / n,
            hidden("stop_ratio"): stat("n_stop") / n,
            hidden("dup_line_ratio"): 1 - stat("n_distinct_lines") / F.greatest(stat("n_lines"), F.lit(1)),
            hidden("distinct_word_ratio"): stat("n_distinct") / n,
            hidden("distinct_triple_ratio"): F.size(F.array_distinct(stat("triples"))) / n,
            hidden("upper_ratio"): per_char("[A-Z]"),
            hidden("mark_ratio"): per_char("[!?]"),
            hidden("digit_ratio"): per_char("[0-9]"),
            hidden("words_per_line"): stat("n_words") / F.greatest(stat("n_lines"), F.lit(1)),
        }
    )


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out.  A null id is held out too."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_SAMPLE) -> DataFrame:
    """Statistics and label of at most ``bound`` learnable rows."""
    chosen = (
        labels.select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label"))
        .where(F.col("label_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("label_id")) != 0))
        .groupBy("label_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(bound)
    )
    # at most ``bound`` rows of two numbers are broadcast
    rows = id_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return with_statistics(rows, "text").select("label", *[stat(s).alias(s) for s in STATS])


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``stat <= bound`` (upper) and ``stat > bound`` terms with its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class Model:
    """Bias and weighted rules; score is the logistic of their sum."""

    bias: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """Score of the statistics as a column expression, 0 to 1."""
        total = F.lit(self.bias)
        for r in self.rules:
            held = F.lit(True)
            for name, upper, bound in r.terms:
                held = held & ((stat(name) <= bound) if upper else (stat(name) > bound))
            total = total + F.when(held, F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        """The same over rows of STATS."""
        total = np.full(len(x), self.bias)
        for r in self.rules:
            total += r.weight * held_rows(r.terms, x)
        return 1 / (1 + np.exp(-total))


def held_rows(terms, x: np.ndarray) -> np.ndarray:
    """Rows of STATS for which all terms hold."""
    out = np.ones(len(x), bool)
    for name, upper, bound in terms:
        v = x[:, STATS.index(name)]
        out &= (v <= bound) if upper else (v > bound)
    return out


def grow(x, residual, hessian, cuts, rows, depth, terms, out, leaf) -> None:
    """Split greedily by gain; every node's path is appended to ``out`` with its rows."""
    if terms:
        out.append((tuple(terms), rows))
    if depth == 0 or len(rows) < 2 * leaf:
        return
    r, h = residual[rows], hessian[rows]
    total, weight, best = r.sum(), h.sum() + 1, (1e-6, None, None)
    for k in range(x.shape[1]):
        v = x[rows, k]
        for c in cuts[k]:
            left = v <= c
            n = int(left.sum())
            if n < leaf or len(rows) - n < leaf:
                continue
            a, b = r[left].sum(), h[left].sum() + 1
            gain = a * a / b + (total - a) ** 2 / (weight - b + 1) - total * total / weight
            if gain > best[0]:
                best = (gain, k, c)
    if best[1] is None:
        return
    _, k, c = best
    left = x[rows, k] <= c
    for upper, part in ((True, rows[left]), (False, rows[~left])):
        grow(x, residual, hessian, cuts, part, depth - 1, [*terms, (STATS[k], upper, float(c))], out, leaf)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rng) -> list:
    """Paths of boosted trees over random halves of the rows and subsets of the statistics."""
    score = np.zeros(len(y))
    found: dict[tuple, None] = {}
    leaf = max(3, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        residual, hessian = y - p, np.maximum(p * (1 - p), 1e-3)
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        use = set(rng.choice(x.shape[1], size=max(3, x.shape[1] * 2 // 3), replace=False).tolist())
        cuts = [
            np.unique(np.quantile(x[rows, k], np.linspace(0.03, 0.97, 16))) if k in use and len(rows) else []
            for k in range(x.shape[1])
        ]
        out: list = []
        grow(x, residual, hessian, cuts, rows, depth, [], out, leaf)
        paths = [t for t, _ in out]
        for terms in paths:
            found[terms] = None
        for terms in (t for t in paths if not any(u[: len(t)] == t and len(u) > len(t) for u in paths)):
            held = held_rows(terms, x)
            score[held] += 0.3 * residual[held].sum() / (hessian[held].sum() + 1)
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, strength: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the bias is free."""
    n, m = z.shape
    # Lipschitz bound of the mean logistic loss, by power iteration
    v = np.ones(m + 1) / np.sqrt(m + 1)
    for _ in range(30):
        u = z @ v[1:] + v[0]
        v = np.concatenate([[u.sum()], z.T @ u])
        size = np.linalg.norm(v)
        v /= size
    step = 4 * n / max(size, 1e-9)
    w = np.zeros(m + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(z @ ahead[1:] + ahead[0]))) - y
        new = ahead - step * np.concatenate([[e.sum()], z.T @ e]) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * strength, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit_rows(
    x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, strength: float = 1e-3, seed: int = 7
) -> Model:
    """Fit the ensemble to rows of STATS and labels."""
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), ())
    rules = tree_rules(x, y, trees, depth, np.random.default_rng(seed))
    z = np.stack([held_rows(t, x) for t in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0))
    if not rules:
        share = float(y.mean())
        return Model(float(np.log(share / (1 - share))), ())
    bias, weights = lasso(z, y, strength)
    kept = [Rule(t, float(round(w, 6))) for t, w in zip(rules, weights.tolist()) if abs(w) > 1e-4]
    return Model(round(bias, 6), tuple(kept))


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_SAMPLE) -> Model:
    """Fit to a bounded sample of labelled documents."""
    found = sample(docs, labels, bound).toPandas()
    found = found.sort_values([*STATS, "label"])  # the order of rows must not change the fit
    return fit_rows(found[list(STATS)].to_numpy(float), found["label"].to_numpy(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    return with_statistics(id_text(docs, id_col, text_col), "text").select("doc_id", model.score().alias("score"))


def keep(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """Documents that score ``threshold`` or more, with all their columns.

    The row mark keeps the optimizer from moving the filter below the statistics, where every term of every
    rule would compute its statistic again.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    scored = with_statistics(docs, text_col).select(
        *own, model.score().alias(PREFIX + "score"), F.monotonically_increasing_id().alias(PREFIX + "mark")
    )
    return scored.where((stat("score") >= threshold) & (stat("mark") >= 0)).select(*own)

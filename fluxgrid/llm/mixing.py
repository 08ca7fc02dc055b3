"""Mixing sources to target weights, with DataFrame functions only.

Weights are token shares raised to an exponent and normalised.  The exponent is searched by bisection, several
halvings in one pass: the largest one whose entropy reaches a target, but never below the smallest one at which
no source is read more often than the repetition limit.  A source's weight times the budget gives its tokens:
whole epochs first, then blocks of a keyed permutation of its documents until the rest is spent, the last block
up to one document.

A pass sums powers of all shares at once by an aggregation over the table of sources; only its sums reach the
driver, so there may be as many sources as hosts.  Everything that a document needs to know is in one row for
its source (exponent, epochs, two thresholds), so applying a mix joins documents to a table of sources and
moves no text.  A source has at most MAX_BLOCKS blocks, whatever its size.

Cases: a null source is a source of its own; null and empty texts have no tokens and come along with their
block; repeated ids (ties) are taken or left together; sources without tokens are read once; very long texts
count whole; other columns are carried along by ``mix``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.llm.common import stored, words_of

#: Halvings of the bisection, and how many of them one pass makes.
STEPS, STEPS_AT_ONCE = 48, 6
#: Most blocks of a source; beyond MAX_BLOCKS * block tokens its blocks grow.
MAX_BLOCKS = 4096
#: Bits of a turn, and of the span of turns in which a source's rest is looked for first.
TURN_BITS, SPAN_BITS = 60, 6


@dataclass(frozen=True)
class Mix:
    """Parameters of a mix.

    entropy: share of the largest entropy that weights should reach; repeats: most epochs of a source;
    budget: tokens in all, None for as many as read the most reduced source once; share: the budget as a multiple
    of all tokens instead; block: tokens of a block.
    """

    entropy: float = 0.99
    repeats: float = 2.0
    budget: float | None = None
    block: int = 200_000
    share: float | None = None


def source_key(source: str = "source") -> Column:
    """Text that tells a null source from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def keyed(what: Column, salt: str) -> Column:
    """60-bit number of a keyed hash."""
    hexed = F.substring(F.md5(F.concat(F.lit(salt + ":"), what)), 1, 15)
    return F.conv(hexed, 16, 10).cast("long")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """src, place (keyed hash of the id), tokens of every document."""
    return docs.select(
        source_key(source_col).alias("src"),
        place(F.col(id_col)).alias("place"),
        F.size(words_of(F.col(text_col))).cast("long").alias("tokens"),
    )


def place(id_col: Column) -> Column:
    """Place of a document in the permutation of its source."""
    return keyed(F.coalesce(id_col.cast("string"), F.lit("")), "place")


def searched(totals: DataFrame, total: float, good) -> float:
    """Largest exponent in [0, 1] of the side where ``good(exponent, Z, sum of v * p^a)`` holds, v the log share.

    Every pass sums the powers at the inner points of the interval and goes on with one of its parts.
    """
    log_share = F.ln(F.col("tokens") / F.lit(total))
    low, high, parts = 0.0, 1.0, 1 << STEPS_AT_ONCE
    for _ in range(STEPS // STEPS_AT_ONCE):
        points = [low + (high - low) * k / parts for k in range(1, parts)]
        at = F.explode(F.array(*[F.lit(a) for a in points])).alias("a")
        power = F.exp(F.col("a") * F.col("v"))
        sums = totals.select(log_share.alias("v"), at).groupBy("a").agg(
            F.sum(power).alias("z"), F.sum(F.col("v") * power).alias("s")
        )
        # a row for each point
        found = {r.a: good(r.a, r.z, r.s) for r in sums.collect()}
        held = [a for a in points if found[a]]
        low, high = max([low, *held]), min([high, *(a for a in points if not found[a])])
    return low


def weights(totals: DataFrame, mix: Mix) -> DataFrame:
    """src, tokens, share, weight, exponent, epochs (real) of each source that has tokens."""
    rows = totals.where(F.col("tokens") > 0)
    # four numbers about all sources
    n, total, most, least = rows.agg(F.count("*"), F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    if not n:
        return rows.select(
            "src", "tokens", *[F.lit(1.0).alias(c) for c in ("share", "weight", "exponent", "epochs")]
        )
    total = float(total)
    top, low, target = math.log(most / total), math.log(least / total), mix.entropy * math.log(n)
    tokens = float(mix.budget) if mix.budget is not None else mix.share * total if mix.share is not None else None

    def entropy_reached(a: float, z: float, s: float) -> bool:
        return math.log(z) - a * s / z >= target

    def most_epochs(a: float, z: float) -> float:
        # epochs of a source with log share v: exp((a - 1) v) * budget / (total * Z); the smallest source has the most
        return math.exp((a - 1) * low) / (math.exp((a - 1) * top) if tokens is None else total * z / tokens)

    def powers(a: float) -> tuple[float, float]:
        v = F.ln(F.col("tokens") / F.lit(total))
        return rows.agg(F.sum(F.exp(a * v)), F.sum(v * F.exp(a * v))).first()

    whole = entropy_reached(1.0, *powers(1.0))
    by_entropy = 1.0 if whole else searched(rows, total, entropy_reached)
    within = most_epochs(0.0, n) <= mix.repeats
    by_repeats = 0.0 if within else searched(rows, total, lambda a, z, _: most_epochs(a, z) > mix.repeats)
    exponent = round(min(1.0, max(by_entropy, by_repeats)), 9)
    z = powers(exponent)[0]
    # without a budget the largest source is read once
    budget = tokens if tokens is not None else total * math.exp(top) / (math.exp(exponent * top) / z)
    share = F.col("tokens") / F.lit(total)
    weight = F.exp(F.lit(exponent) * F.ln(share)) / F.lit(z)
    return rows.select(
        "src",
        "tokens",
        share.alias("share"),
        weight.alias("weight"),
        F.lit(exponent).alias("exponent"),
        F.round(weight * F.lit(budget) / F.col("tokens"), 9).alias("epochs"),
    )


def plan(count: DataFrame, mix: Mix) -> DataFrame:
    """One row for each source: weight, full epochs, blocks, thresholds of the last, partial epoch."""
    totals = stored(count.groupBy("src").agg(F.sum("tokens").alias("tokens")), "mix-totals")
    shares = weights(totals, mix).select(
        "src",
        "share",
        "weight",
        "exponent",
        "epochs",
        F.floor("epochs").cast("long").alias("full"),
        F.floor((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).cast("long").alias("rest"),
        F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("tokens") / mix.block)).cast("long").alias("n_blocks"),
    )
    # a block is a slice of the permutation; its turn in an epoch is a second permutation
    dealt = count.join(shares.select("src", "n_blocks"), "src").withColumn("block", block_of(F.col("place")))
    blocks = dealt.groupBy("src", "block").agg(F.sum("tokens").alias("tokens")).withColumn("turn", turn_of("src", "block"))
    # the turn at which a source's rest is spent: first its span of turns, then the block within the span
    blocks = blocks.withColumn("span", F.shiftright("turn", TURN_BITS - SPAN_BITS))
    spans = blocks.groupBy("src", "span").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("src").orderBy("span"))
    passed = spans.select("src", "span", "tokens", upto.alias("spent")).join(shares.select("src", "rest"), "src")
    span = (
        passed.where(F.col("spent") > F.col("rest"))
        .groupBy("src", "rest")
        .agg(F.min(F.struct("span", (F.col("spent") - F.col("tokens")).alias("before"))).alias("first"))
        .select("src", "rest", F.col("first.span").alias("span"), F.col("first.before").alias("before"))
    )
    inner = F.sum("tokens").over(Window.partitionBy("src").orderBy("turn", "block")) + F.col("before")
    ends = blocks.join(span, ["src", "span"]).select("src", "block", "turn", "tokens", "rest", inner.alias("spent"))
    cut = (
        ends.where(F.col("spent") > F.col("rest"))
        .groupBy("src")
        .agg(F.min(F.struct("turn", "block", (F.col("rest") - F.col("spent") + F.col("tokens")).alias("left"))).alias("cut"))
        .select("src", F.col("cut.turn").alias("cut_turn"), F.col("cut.block").alias("cut_block"), F.col("cut.left").alias("left"))
    )
    inside = F.sum("tokens").over(Window.partitionBy("src").orderBy("place"))
    last = (
        dealt.join(cut, "src")
        .where(F.col("block") == F.col("cut_block"))
        .select("src", "place", "left", inside.alias("spent"))
        .where(F.col("spent") <= F.col("left"))
        .groupBy("src")
        .agg(F.max("place").alias("last_place"))
    )
    return shares.join(cut.drop("left"), "src", "left").join(last, "src", "left")


def block_of(place_col: Column) -> Column:
    """Block of a place; needs n_blocks."""
    return F.pmod(place_col, F.greatest(F.col("n_blocks"), F.lit(1)))


def turn_of(src: str, block: str) -> Column:
    """Turn of a block in an epoch."""
    return keyed(F.concat_ws("/", F.col(src), F.col(block).cast("string")), "turn")


def copies() -> Column:
    """How often a document is taken; needs place and the columns of a plan."""
    block = block_of(F.col("place"))
    turn = keyed(F.concat_ws("/", F.col("src"), block.cast("string")), "turn")
    partly = (
        F.when(F.col("cut_turn").isNull(), F.lit(1))
        .when((turn < F.col("cut_turn")) | ((turn == F.col("cut_turn")) & (block < F.col("cut_block"))), F.lit(1))
        .when((block == F.col("cut_block")) & (F.col("place") <= F.col("last_place")), F.lit(1))
        .otherwise(F.lit(0))
    )
    return F.coalesce(F.col("full") + F.when(F.col("rest") > 0, partly).otherwise(F.lit(0)), F.lit(1).cast("long"))


def drawn(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """(documents as a struct ``doc``, src, place, plan columns, n_copies); the plan joins by source."""
    count = stored(counted(docs, id_col, text_col, source_col), "mix-counts")
    table = stored(plan(count, mix), "mix-plan")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        source_key(source_col).alias("src"),
        place(F.col(id_col)).alias("place"),
    )
    # one row for each source: small enough to broadcast in all but odd cases, which Spark decides by its size
    return rows.join(table, "src", "left").withColumn("n_copies", copies())


def mix_rows(docs: DataFrame, mix: Mix = Mix(), **columns: str) -> DataFrame:
    """The mixed documents with all their columns, repeated as drawn."""
    rows = drawn(docs, mix, **columns).where(F.col("n_copies") > 0)
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select("doc.*")


def sql(mix: Mix) -> str:
    """The draws of ``documents`` in SQL, for a mix without a budget or with a share of all tokens."""
    keyed_sql = lambda text, salt: f"('0x' || substr(md5('{salt}:' || {text}), 1, 15))::BIGINT"
    entropy_at = lambda a: (
        f"(SELECT ln(sum(exp({a} * v))) - sum(exp({a} * v) * {a} * v) / sum(exp({a} * v)) FROM logs)"
    )
    z_at = lambda a: f"(SELECT sum(exp({a} * v)) FROM logs)"
    if mix.share is None:
        most = lambda a: f"exp(({a} - 1) * (low - top))"
        budget = "total * exp(top) / (exp(a * top) / z)"
    else:
        most = lambda a: f"(exp(({a} - 1) * low) * {mix.share} / {z_at(a)})"
        budget = f"{mix.share} * total"
    turn = keyed_sql("(src || '/' || block::VARCHAR)", "turn")
    return rf"""
    WITH RECURSIVE base AS (
      SELECT doc_id, source, coalesce('=' || source, '') AS src, {keyed_sql("coalesce(doc_id::VARCHAR, '')", "place")} AS place,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents
    ), tot AS (SELECT src, sum(tokens)::DOUBLE AS tokens FROM base GROUP BY src HAVING sum(tokens) > 0
    ), logs AS (SELECT src, tokens, ln(tokens / (SELECT sum(tokens) FROM tot)) AS v FROM tot
    ), ext AS (SELECT max(v) AS top, min(v) AS low, {mix.entropy} * ln(count(*)::DOUBLE) AS target, sum(tokens) AS total FROM logs
    ), bis AS (
      SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
      UNION ALL
      SELECT step + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END FROM (
        SELECT step, lo, hi, mid, {entropy_at("mid")} >= target AS good FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis), ext WHERE step < {STEPS})
    ), rep AS (
      SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
      UNION ALL
      SELECT step + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END FROM (
        SELECT step, lo, hi, mid, {most("mid")} > {mix.repeats} AS good FROM (SELECT *, (lo + hi) / 2 AS mid FROM rep), ext WHERE step < {STEPS})
    ), chosen AS (
      SELECT round(least(1.0, greatest(
        CASE WHEN {entropy_at("1.0")} >= target THEN 1.0 ELSE (SELECT lo FROM bis WHERE step = {STEPS}) END,
        CASE WHEN {most("0.0")} <= {mix.repeats} THEN 0.0 ELSE (SELECT lo FROM rep WHERE step = {STEPS}) END)), 9)::DOUBLE AS a, top, total FROM ext
    ), zed AS (SELECT a, top, total, (SELECT sum(exp(a * v)) FROM logs) AS z FROM chosen
    ), shares AS (
      SELECT src, tokens, tokens / total AS share, exp(a * v) / z AS weight,
        round(exp(a * v) / z * ({budget}) / tokens, 9) AS epochs FROM logs, zed
    ), parts AS (
      SELECT *, floor(epochs)::BIGINT AS n_full, floor((epochs - floor(epochs)) * tokens)::BIGINT AS rest, least({MAX_BLOCKS}, ceil(tokens / {mix.block}))::BIGINT AS n_blocks FROM shares
    ), dealt AS (SELECT base.*, parts.* EXCLUDE (src, tokens), place % greatest(n_blocks, 1) AS block FROM base JOIN parts USING (src)
    ), blocks AS (SELECT src, block, any_value(rest) AS rest, sum(tokens) AS tokens, {turn} AS turn FROM dealt GROUP BY src, block
    ), ends AS (SELECT *, sum(tokens) OVER (PARTITION BY src ORDER BY turn, block) AS spent FROM blocks
    ), cut AS (
      SELECT src, turn AS cut_turn, block AS cut_block, rest - spent + tokens AS remains
      FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY turn, block) AS k FROM ends WHERE spent > rest) WHERE k = 1
    ), last AS (
      SELECT src, max(place) AS last_place FROM (
        SELECT dealt.src, place, remains, sum(dealt.tokens) OVER (PARTITION BY dealt.src ORDER BY place) AS spent
        FROM dealt JOIN cut ON dealt.src = cut.src AND block = cut_block) WHERE spent <= remains GROUP BY src
    ), taken AS (
      SELECT dealt.*, {turn.replace("src", "dealt.src")} AS turn, cut_turn, cut_block, last_place
      FROM dealt LEFT JOIN cut USING (src) LEFT JOIN last USING (src)
    ), known AS (
      SELECT *, n_full + CASE WHEN rest <= 0 THEN 0 WHEN cut_turn IS NULL THEN 1
        WHEN turn < cut_turn OR (turn = cut_turn AND block < cut_block) THEN 1
        WHEN block = cut_block AND place <= last_place THEN 1 ELSE 0 END AS n_copies FROM taken
    )
    SELECT doc_id, source, round(share, 6) AS share, round(weight, 6) AS weight, round(epochs, 6) AS epochs, n_copies::BIGINT AS n_copies FROM known
    UNION ALL
    SELECT doc_id, source, NULL, NULL, NULL, 1::BIGINT FROM base WHERE src NOT IN (SELECT src FROM tot)"""

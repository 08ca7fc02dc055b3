"""Tables and palettes from JSON, named columns, array text and array digests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.model import Numbers, literal_array, to_kind
from fluxgrid.operators.matrices import colour

MAX_INDEX = 1 << 24


def index_table(
    spark: SparkSession, table: str, named_indexes: str = "{}", named_values: str = "{}", kind: str = "int",
    least_length: int = 0, filler: float = 0.0, base: int = 0, allow_low: bool = False,
) -> Numbers:
    """A dense one-column table of a JSON map from index (or name) to number (or name)."""
    indexes, names, found = json.loads(named_indexes), json.loads(named_values), {}
    for key, value in json.loads(table).items():
        k = int(indexes.get(key, key)) - base
        if k >= MAX_INDEX:
            raise ValueError(f"index {key} is too large")
        if k < 0:
            if allow_low:
                continue
            raise ValueError(f"index {key} is too low")
        found[k] = float(names.get(value, value) if isinstance(value, str) else value)
    n = max([least_length, *(k + 1 for k in found)])
    pairs = F.create_map(*[F.lit(v) for k, w in found.items() for v in (k, w)]) if found else None
    value = F.coalesce(F.try_element_at(pairs, F.col("id").cast("int")), F.lit(float(filler))) if found else F.lit(float(filler))
    return Numbers(spark.range(n).select(F.col("id").alias("_i"), to_kind(value, kind).alias("c0")), ("c0",), kind)


def palette(spark: SparkSession, table: str, named_indexes: str = "{}", channels: int = 3, default: str = "#000000", base: int = 0) -> Numbers:
    """Rows of colour channels in 0..1 of a JSON map from index (or name) to colour."""
    indexes, found = json.loads(named_indexes), {}

    def row(value) -> list[float]:
        shares = colour(value) if isinstance(value, str) else [float(value)] * channels
        return [shares[k] if k < len(shares) else 0.0 for k in range(channels)]

    for key, value in json.loads(table).items():
        found[int(indexes.get(key, key)) - base] = row(value)
    n = max([0, *(k + 1 for k in found)])
    return literal_array(spark, [found.get(k, row(default)) for k in range(n)])


def area_scalars(x: Numbers) -> DataFrame:
    """min_x, max_x, min_y... of an array of (min, max) rows."""
    cols = []
    for k, axis in enumerate("xyz"):
        for c, name in zip(x.columns, ("min", "max")):
            cols.append(F.max(F.when(F.col("_i") == k, F.col(c))).alias(f"{name}_{axis}"))
    return x.df.agg(*cols)


def named_columns(inputs: list[tuple[Numbers, list[str]]], wanted: list[str], all_required: bool = False) -> Numbers:
    """Named columns, each from the first array that has it; missing ones are NaN."""
    from fluxgrid.model import zipped

    df, aliases = zipped(*[n for n, _ in inputs])
    cols = {}
    for w in wanted:
        hit = next(((k, names.index(w)) for k, (_, names) in enumerate(inputs) if w in names), None)
        if hit is None and all_required:
            raise ValueError(f"no column {w}")
        cols[w] = F.lit(float("nan")) if hit is None else F.col(aliases[hit[0]][hit[1]]).cast("double")
    return Numbers(df.select("_i", *[e.alias(c) for c, e in cols.items()]), tuple(cols), "double")


def text_lines(x: Numbers, delimiter: str = ", ", pattern: str | None = None, line_numbers: bool = False, base: int = 0) -> DataFrame:
    """``_i`` and the text of each row; a sink joins the lines in order."""
    from fluxgrid.functions.scalars import joined_numbers

    line = joined_numbers(F.array(*[F.col(c).cast("double") for c in x.columns]), delimiter, pattern)
    if line_numbers:
        line = F.concat((F.col("_i") + base).cast("string"), F.lit(": "), line)
    return x.df.select("_i", line.alias("line"))


def array_digest(x: Numbers) -> DataFrame:
    """A digest that depends on kind, width, positions and values, folded without ordering rows."""
    row = F.xxhash64(F.lit(x.kind), F.lit(x.block_length), "_i", *x.columns)
    return x.df.agg(F.count("*").alias("n"), F.bit_xor(row).alias("hash"))


def length(x: Numbers, raw: bool = False) -> DataFrame:
    """Rows, or elements."""
    return x.df.agg((F.count("*") * (x.block_length if raw else 1)).alias("length"))

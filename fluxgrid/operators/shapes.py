"""Row and column operators of number arrays: projections, filters, unions, zips, replacement, creation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.model import SPARK_TYPES, Numbers, literal_array, to_kind, zipped
from fluxgrid.operators.arithmetic import within


def extract(x: Numbers, start: int = 0, count: int = 0) -> Numbers:
    """Rows from ``start``, numbered anew; ``count`` 0 goes to the end."""
    rows = F.col("_i") >= start
    if count:
        rows = rows & (F.col("_i") < start + count)
    df = x.df.where(rows).withColumn("_i", F.col("_i") - start)
    return Numbers(df.select("_i", *x.columns), x.columns, x.kind)


def resolved(names: list[str], wanted: str) -> list[int]:
    """Column places by name, by 1-based number, or by a negative number from the end."""
    out = []
    for w in re.split(r"[\s,;]+", wanted.strip()):
        if w in names:
            out.append(names.index(w))
            continue
        k = int(w)
        if k == 0 or abs(k) > len(names):
            raise ValueError(f"no column {w}")
        out.append(k - 1 if k > 0 else len(names) + k)
    return out


def columns_by_name(x: Numbers, names: list[str], wanted: str) -> tuple[Numbers, list[str]]:
    """Chosen columns and their names."""
    places = resolved(names, wanted)
    cols = {f"c{j}": F.col(x.columns[p]) for j, p in enumerate(places)}
    return x.with_columns(cols), [names[p] for p in places]


def split_columns(x: Numbers) -> list[Numbers]:
    """One array for each column."""
    return [x.slice(k, 1) for k in range(x.block_length)]


def keep_in_range(x: Numbers, low=None, high=None, column: int = 0, invert=False, selector: Numbers | None = None) -> Numbers:
    """Rows whose column (or selector) is in a range; positions stay those of the input.

    ``renumbered`` gives new positions where a later operator needs them.
    """
    if low is not None and high is not None and low > high:
        return Numbers(x.df.limit(0), x.columns, x.kind)
    if selector is None:
        held = within(F.col(x.columns[column]).cast("double"), low, high)
        return Numbers(x.df.where(~held if invert else held), x.columns, x.kind)
    held = within(F.col(selector.columns[column]).cast("double"), low, high)
    keep = selector.df.where(~held if invert else held).select("_i")
    return Numbers(x.df.join(keep, "_i", "left_semi"), x.columns, x.kind)


def renumbered(x: Numbers) -> Numbers:
    """Contiguous positions in the order of the old ones."""
    from fluxgrid.model import numbered

    df = numbered(x.df.withColumnRenamed("_i", "_old"), ["_old"]).select("_i", *x.columns)
    return Numbers(df, x.columns, x.kind)


def merge_rows(inputs: list[Numbers | None], result: str = "FIRST_INPUT") -> Numbers:
    """Arrays one after the other; positions go on."""
    given = [n for n in inputs if n is not None]
    if not given:
        raise ValueError("no input")
    if len({n.block_length for n in given}) > 1:
        raise ValueError("different block lengths")
    if result == "REQUIRE_IDENTICAL" and len({n.kind for n in given}) > 1:
        raise ValueError("different element kinds")
    kind = given[0].kind if result in {"FIRST_INPUT", "REQUIRE_IDENTICAL"} else result.lower()
    columns, out, start = given[0].columns, None, F.lit(0).cast("bigint")
    parts = []
    for k, n in enumerate(given):
        cols = [to_kind(F.col(c), kind).alias(a) for c, a in zip(n.columns, columns)]
        parts.append(n.df.select(F.lit(k).alias("_k"), "_i", *cols))
        out = parts[0] if k == 0 else out.unionByName(parts[k])
    # one count for each input; at most 32 rows
    sizes = out.groupBy("_k").agg(F.count("*").alias("_n"))
    table = sizes.agg(F.map_from_entries(F.collect_list(F.struct("_k", "_n"))).alias("_sizes"))
    rows = out.crossJoin(F.broadcast(table))
    before = sum((F.when(F.col("_k") > k, F.coalesce(F.col("_sizes")[k], F.lit(0))).otherwise(0) for k in range(len(given))), start)
    df = rows.withColumn("_i", (F.col("_i") + before).cast("bigint")).select("_i", *columns)
    return Numbers(df, columns, kind)


def merge_columns(inputs: list[Numbers | None]) -> Numbers:
    """Arrays side by side."""
    given = [n for n in inputs if n is not None]
    df, names = zipped(*given)
    flat = [a for own in names for a in own]
    cols = {f"c{k}": to_kind(F.col(a), given[0].kind) for k, a in enumerate(flat)}
    return Numbers(df.select("_i", *[e.alias(c) for c, e in cols.items()]), tuple(cols), given[0].kind)


def replace_rows(x: Numbers, by: Numbers, start: int = 0, start_in_replacer: int = 0, count: int = 0) -> Numbers:
    """Rows from ``start`` overwritten by rows of another array; 0 takes as many as there are."""
    moved = by.df.select(
        (F.col("_i") - start_in_replacer + start).alias("_i"),
        *[to_kind(F.col(c), x.kind).alias(f"r{k}") for k, c in enumerate(by.columns)],
        F.lit(True).alias("_new"),
    ).where(F.col("_i") >= start)
    if count:
        moved = moved.where(F.col("_i") < start + count)
    df = x.df.join(moved, "_i", "left")
    cols = [F.when(F.col("_new"), F.col(f"r{k}")).otherwise(F.col(c)).alias(c) for k, c in enumerate(x.columns)]
    return Numbers(df.select("_i", *cols), x.columns, x.kind)


def replace_columns(x: Numbers, by: Numbers, start: int = 0, start_in_replacer: int = 0, count: int = 0) -> Numbers:
    """Columns from ``start`` overwritten by columns of another array."""
    part = by.slice(start_in_replacer, count)
    df, (a, b) = zipped(x, part)
    cols = [F.col(p) for p in a]
    for k, q in enumerate(b):
        cols[start + k] = to_kind(F.col(q), x.kind)
    return Numbers(df.select("_i", *[e.alias(c) for e, c in zip(cols, x.columns)]), x.columns, x.kind)


def rounded(x: Numbers, kind: str = "float") -> Numbers:
    """Half to even, then cast."""
    return x.map(lambda c: F.rint(c.cast("double")), kind)


def fill_progression(x: Numbers, start_value: float, increment: float, start: int = 0, count: int = 0) -> Numbers:
    """Columns replaced by an arithmetic progression over rows."""
    chosen = set(x.columns[start : start + count if count else None])
    value = to_kind(F.lit(float(start_value)) + F.col("_i") * float(increment), x.kind)
    return x.with_columns({c: value if c in chosen else F.col(c) for c in x.columns})


def progression(spark: SparkSession, n: int, start: float = 0.0, increment: float = 0.0, width: int = 1, kind: str = "float") -> Numbers:
    """start + row * increment in every column."""
    df = spark.range(n).select(
        F.col("id").alias("_i"), *[to_kind(F.lit(float(start)) + F.col("id") * float(increment), kind).alias(f"c{k}") for k in range(width)]
    )
    return Numbers(df, tuple(f"c{k}" for k in range(width)), kind)


def random_numbers(spark: SparkSession, n: int, low=0.0, high=1.0, seed: int = 1, width: int = 1, kind: str = "float") -> Numbers:
    """Uniform numbers; seed 0 draws a new seed."""
    draw = [F.rand(seed + k) if seed else F.rand() for k in range(width)]
    df = spark.range(n).select(
        F.col("id").alias("_i"), *[to_kind((d * (high - low) + low).cast("float"), kind).alias(f"c{k}") for k, d in enumerate(draw)]
    )
    return Numbers(df, tuple(f"c{k}" for k in range(width)), kind)


def from_text(spark: SparkSession, text: str, width: int = 1, single: bool = False, kind: str = "float") -> Numbers:
    """Numbers split by white space, commas and semicolons."""
    values = [float(v) for v in re.split(r"[,;\s]+", text.strip()) if v]
    width = len(values) if single else width
    if not width or len(values) % width:
        raise ValueError("the numbers do not fill whole rows")
    rows = [values[k : k + width] for k in range(0, len(values), width)]
    return literal_array(spark, rows, "double").cast(kind)


def rectangle(spark: SparkSession, axes: list[tuple[float | None, float | None, float | None]], kind: str = "LONG") -> Numbers:
    """(min, max) rows of 1 to 3 axes from (min, max, size); a size overrides max."""
    rows = []
    for low, high, size in axes:
        low = 0.0 if low is None else float(low)
        if size is not None:
            high = low + size - (1 if kind == "LONG" else 0)
        rows.append([low, float(high)])
    return literal_array(spark, rows, "double").cast("long" if kind == "LONG" else "double")


def json_numbers(json_column: str, df: DataFrame, index: str, types: str = "ALL") -> DataFrame:
    """index, position, key, value of JSON objects: numbers, numeric text and booleans as doubles."""
    entries = F.from_json(F.col(json_column), "map<string,string>")
    rows = df.select(F.col(index), F.posexplode(F.map_entries(entries)).alias("position", "entry"))
    text = F.col("entry.value")
    value = (
        F.when(F.lower(text) == "true", F.lit(1.0)).when(F.lower(text) == "false", F.lit(0.0)).otherwise(text.try_cast("double"))
    )
    rows = rows.select(index, "position", F.col("entry.key").alias("key"), F.coalesce(value, F.lit(float("nan"))).alias("value"))
    is_number = ~F.isnan("value")
    if types in {"NUMBERS", "NUMBERS_AND_NUMERIC_STRINGS"}:
        return rows.where(is_number)
    if types in {"NON_ZERO_NUMBERS", "NON_ZERO_NUMBERS_AND_NUMERIC_STRINGS"}:
        return rows.where(is_number & (F.col("value") != 0))
    return rows


def numbers_json(x: Numbers, keys: list[str], value_kind: str = "DOUBLE", start: float = 1, increment: float = 1) -> DataFrame:
    """One JSON object of the first column under given keys; short arrays go on with a progression."""
    spark = x.df.sparkSession
    names = spark.range(1).select(F.posexplode(F.array(*[F.lit(k) for k in keys])).alias("_i", "key"))
    rows = names.join(x.df.select("_i", F.col(x.columns[0]).cast("double").alias("v")), "_i", "left")
    value = F.coalesce("v", F.lit(float(start)) + F.col("_i") * float(increment))
    kinds = {
        "DOUBLE": value,
        "INTEGER": F.floor(value + 0.5).cast("bigint"),
        "BOOLEAN": value != 0,
        "STRING": value.cast("string"),
    }
    pairs = F.sort_array(F.collect_list(F.struct("_i", "key", kinds[value_kind].alias("value"))))
    return rows.agg(
        F.to_json(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["key"], p["value"])))).alias("json")
    )


def element_type(kind: str) -> str:
    """Spark type of an element kind."""
    return SPARK_TYPES[kind]

"""Statistics, histograms, percentiles and contrast of number arrays: aggregations without collected arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.model import Numbers, to_kind


def info(x: Numbers) -> DataFrame:
    """One row: counts, mean, sum and extremes over all elements, and over finite ones; one pass without a shuffle of rows."""
    whole = [F.col(c).cast("double") for c in x.columns]
    real = [F.when(~F.isnan(v), v) for v in whole]
    finite = [F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) for v in whole]
    several = x.block_length > 1
    over = lambda agg, pick, cols: pick(*[agg(c) for c in cols]) if several else agg(cols[0])
    plus = lambda *cols: sum(cols[1:], cols[0])
    size = lambda c: F.abs(c)
    found = x.df.agg(
        F.count("*").alias("n"),
        over(lambda c: F.coalesce(F.sum(c), F.lit(0.0)), plus, whole).alias("sum"),
        over(F.min, F.least, real).alias("min"),
        over(F.max, F.greatest, real).alias("max"),
        over(lambda c: F.max(size(c)), F.greatest, real).alias("max_abs"),
        over(F.min, F.least, finite).alias("min_of_ordinary"),
        over(F.max, F.greatest, finite).alias("max_of_ordinary"),
        over(lambda c: F.max(size(c)), F.greatest, finite).alias("max_abs_of_ordinary"),
    )
    length = (F.col("n") * x.block_length).alias("array_length")
    return found.select(
        "n",
        F.lit(x.block_length).alias("block_length"),
        length,
        F.when(F.col("n") > 0, F.col("sum") / (F.col("n") * x.block_length)).alias("mean"),
        "sum",
        F.coalesce("min", F.lit(float("inf"))).alias("min"),
        F.coalesce("max", F.lit(float("-inf"))).alias("max"),
        "max_abs",
        "min_of_ordinary",
        "max_of_ordinary",
        "max_abs_of_ordinary",
    )


def column_statistics(x: Numbers) -> DataFrame:
    """A row for each column: n, sum, mean, population variance and deviation; one pass over the rows."""
    rules = {"n": F.count, "sum": F.sum, "mean": F.avg, "variance": F.var_pop, "standard_deviation": F.stddev_pop}
    each = [
        F.struct(F.lit(k).alias("column"), *[rule(F.col(c).cast("double")).alias(name) for name, rule in rules.items()])
        for k, c in enumerate(x.columns)
    ]
    return x.df.agg(F.array(*each).alias("all")).select(F.inline("all"))


#: Elements that may be ranked as they are, and the accuracy of the sketches that narrow larger sets down.
FEW, ACCURACY = 100_000, 10_000


def brackets(rows: DataFrame, places: list[int], n: int) -> list[tuple[float | None, float | None, int]]:
    """(low, high, elements below low) for each place among n sorted values v; few elements lie in a bracket.

    Every pass sketches the quantiles around each place within its bracket, then counts exactly, so it narrows
    brackets by thousands of times; only a few numbers for each place reach the driver.
    """
    state: list[tuple[float | None, float | None, int]] = [(None, None, 0)] * len(places)
    size = [n] * len(places)

    def inside(low, high):
        out = F.lit(True)
        out = out if low is None else out & (F.col("v") >= low)
        return out if high is None else out & (F.col("v") <= high)

    open_places = [k for k in range(len(places)) if size[k] > FEW]
    while open_places:
        sketches = []
        for k in open_places:
            low, high, below = state[k]
            share, margin = (places[k] - below + 0.5) / size[k], 3.0 / ACCURACY
            around = [max(0.0, share - margin), min(1.0, share + margin)]
            sketches.append(F.percentile_approx(F.when(inside(low, high), F.col("v")), around, ACCURACY).alias(f"s{k}"))
        cuts = rows.agg(*sketches).first()
        counts = []
        for k in open_places:
            a, z = cuts[f"s{k}"]
            counts += [F.count(F.when(F.col("v") < a, 1)).alias(f"b{k}"), F.count(F.when(F.col("v").between(a, z), 1)).alias(f"m{k}")]
        found = rows.agg(*counts).first()
        left = []
        for k in open_places:
            a, z = cuts[f"s{k}"]
            hit = found[f"b{k}"] <= places[k] < found[f"b{k}"] + found[f"m{k}"]
            if not hit:  # a sketch beyond its margin: leave the rest to the exact ranking
                continue
            smaller = found[f"m{k}"] < size[k]
            state[k], size[k] = (a, z, found[f"b{k}"]), found[f"m{k}"]
            if size[k] > FEW and smaller and a < z:
                left.append(k)
        open_places = left
    return state


def percentiles(x: Numbers, levels: list[float], column: int = 0) -> DataFrame:
    """level, value: the element at round(level * (n - 1)) of the sorted column; NaN is the largest value.

    Places are narrowed down by passes of sketches and counts; only values near a place are counted and ranked.
    """
    v = F.col(x.columns[column]).cast("double")
    every = x.df.select(v.alias("v")).where("v IS NOT NULL")
    spark = x.df.sparkSession
    rows = every.where(~F.isnan("v"))
    n, nans = every.agg(F.count("*"), F.count(F.when(F.isnan("v"), 1))).first()
    places = [int(math.floor(p * (n - 1) + 0.5)) for p in levels]
    real = [k for k, place in enumerate(places) if n and place < n - nans]
    parts = [spark.range(1).select(F.lit(float(p)).alias("level"), F.lit(float("nan")).alias("value")) for k, p in enumerate(levels) if k not in real]
    for k, (low, high, below) in zip(real, brackets(rows, [places[k] for k in real], n - nans)):
        near = rows
        if low is not None:
            near = near.where(F.col("v").between(low, high))
        counts = near.groupBy("v").count()
        upto = F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("v"))
        ranked = counts.select("v", "count", (upto + below).alias("last"))
        hit = ranked.where((F.col("last") > places[k]) & (F.col("last") - F.col("count") <= places[k]))
        parts.append(hit.select(F.lit(float(levels[k])).alias("level"), F.col("v").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def all_statistics(
    x: Numbers, levels: list[float] = (), bins: int = 100, low: float | None = None, high: float | None = None,
    index_in_block: int = 0, length_in_block: int = 0,
) -> DataFrame:
    """One row of everything about the elements of some columns of every row.

    histogram, mean, sum, variance, standard_deviation, percentiles, number_of_blocks, block_length, array_length,
    hash (a digest that needs no order of rows).
    """
    part = x.slice(index_in_block, length_in_block)
    cols = [F.col(c).cast("double") for c in part.columns]
    flat = Numbers(part.df.select(F.explode(F.array(*cols)).alias("c0")), ("c0",), "double")
    one = part.df.agg(
        F.count("*").alias("number_of_blocks"),
        F.coalesce(F.sum(F.xxhash64("_i", *part.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"),
    )
    numbers = flat.df.agg(
        F.sum("c0").alias("sum"), F.avg("c0").alias("mean"), F.var_pop("c0").alias("variance"), F.stddev_pop("c0").alias("standard_deviation")
    )
    bars = histogram(flat, bins, low, high).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "n"))), lambda b: b["n"]).alias("histogram"))
    for p in levels:
        if not 0 <= p <= 1:
            raise ValueError(f"a percentile level beyond 0..1: {p}")
    order = F.array(*[F.lit(float(p)) for p in levels]) if levels else F.array().cast("array<double>")
    found = x.df.sparkSession.range(1).select(F.array().cast("array<struct<level:double,value:double>>").alias("found"))
    if levels:
        found = percentiles(flat, sorted(set(levels))).agg(F.collect_list(F.struct("level", "value")).alias("found"))
    value = lambda p: F.filter("found", lambda f: f["level"] == p)[0]["value"]
    # four tables of one row
    row = one.crossJoin(numbers).crossJoin(bars).crossJoin(found)
    return row.select(
        "histogram", "mean", "sum", "variance", "standard_deviation", F.transform(order, value).alias("percentiles"),
        "number_of_blocks", F.lit(part.block_length).alias("block_length"), (F.col("number_of_blocks") * part.block_length).alias("array_length"), "hash",
    )


def histogram(x: Numbers, bins: int = 100, low: float | None = None, high: float | None = None, column: int = 0) -> DataFrame:
    """bin, n of a column; the default range puts the largest value in the last bin; empty bins hold 0."""
    v = F.col(x.columns[column]).cast("double")
    if low is None or high is None:
        least, most = x.df.agg(F.min(v), F.max(v)).first()
        low = least if low is None else low
        if high is None:
            high = low + (most - low) * (bins / (bins - 1.0)) if bins > 1 else most
    width = (high - low) / bins
    place = F.lit(0) if width == 0 else F.floor((v - low) / width)
    rows = x.df.where(v == low if width == 0 else (place >= 0) & (place < bins))
    found = rows.groupBy(place.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    return x.df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(found, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n")
    )


def limit_value(kind: str, limit: float, least: float, most: float, cumulated) -> float:
    """A limit as a value: absolute, as a share of the range, or as a percentile."""
    if kind == "ABSOLUTE_VALUE":
        return limit
    if kind == "VALUE_BETWEEN_MIN_AND_MAX":
        return least + (most - least) * limit
    return cumulated(limit)


def contrast(
    x: Numbers, low: float = 0.0, high: float = 1.0, low_kind: str = "PERCENTILE_BETWEEN_MIN_AND_MAX",
    high_kind: str = "PERCENTILE_BETWEEN_MIN_AND_MAX", result_min=0.0, result_max=1.0, truncate=True, invert_selector=False,
) -> tuple[Numbers, Numbers, float, float]:
    """Linear map of low..high limits to result_min..result_max, a selector of values inside, and the limits."""
    v = F.col(x.columns[0]).cast("double")
    least, most = x.df.agg(F.min(v), F.max(v)).first()

    def cumulated(level: float) -> float:
        return percentiles(x, [level]).first()["value"]

    a = limit_value(low_kind, low, least, most, cumulated)
    b = limit_value(high_kind, high, least, most, cumulated)

    def f(c: Column) -> Column:
        d = c.cast("double")
        if a == b:
            return d
        out = F.lit(float(result_min)) + (d - a) * ((result_max - result_min) / (b - a))
        top, bottom = max(result_min, result_max), min(result_min, result_max)
        return F.least(F.greatest(out, F.lit(float(bottom))), F.lit(float(top))) if truncate else out

    inside = F.lit(1) if a == b else v.between(a, b).cast("int")
    selector = x.with_columns({"c0": to_kind((1 - inside) if invert_selector else inside, "int")}, "int")
    return x.map(f, "float" if x.kind != "double" else "double"), selector, a, b

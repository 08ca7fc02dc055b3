"""Sort, index tables, nearest centres, padding and single elements of number arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.model import Numbers, numbered, to_kind


def element(x: Numbers, row: int = 0, column: int = 0, raw: int | None = None) -> DataFrame:
    """One element as ``value``, by row and column or by flat index."""
    if raw is not None:
        row, column = divmod(raw, x.block_length)
    return x.df.where(F.col("_i") == row).select(F.col(x.columns[column]).alias("value"))


def with_element(x: Numbers, value: float, row: int = 0, column: int = 0, raw: int | None = None) -> Numbers:
    """One element replaced."""
    if raw is not None:
        row, column = divmod(raw, x.block_length)
    c = x.columns[column]
    new = F.when(F.col("_i") == row, to_kind(F.lit(float(value)), x.kind)).otherwise(F.col(c))
    return x.with_columns({n: new if n == c else F.col(n) for n in x.columns})


def sort(x: Numbers, column: int = 0, descending: bool = False, base: int = 1) -> tuple[Numbers, Numbers, Numbers]:
    """Sorted rows, their former places, and the places that former rows took.

    Ties keep the order of positions, or reverse it when descending; negated keys give both by one sort.
    """
    key = F.col(x.columns[column]).cast("double")
    sign = -1 if descending else 1
    rows = x.df.select("_i", *x.columns, (key * sign).alias("_key"), (F.col("_i") * sign).alias("_tie"))
    ranked = numbered(rows.withColumnRenamed("_i", "_was"), ["_key", "_tie"])
    result = Numbers(ranked.select("_i", *x.columns), x.columns, x.kind)
    places = Numbers(ranked.select("_i", (F.col("_was") + base).cast("int").alias("c0")), ("c0",), "int")
    reverse = Numbers(
        ranked.select(F.col("_was").alias("_i"), (F.col("_i") + base).cast("int").alias("c0")), ("c0",), "int"
    )
    return result, places, reverse


def invert_table(table: Numbers, base: int = 1) -> Numbers:
    """result[table[k] - base] = k + base; the first k wins, gaps hold -1."""
    spark = table.df.sparkSession
    target = F.col(table.columns[0]).cast("bigint") - base
    hits = table.df.select(target.alias("_t"), "_i").where("_t >= 0").groupBy("_t").agg(F.min("_i").alias("_k"))
    top = hits.agg(F.coalesce(F.max("_t"), F.lit(-1))).first()[0]
    dense = spark.range(top + 1).withColumnRenamed("id", "_i")
    df = dense.join(hits, F.col("_i") == F.col("_t"), "left").select(
        "_i", F.coalesce((F.col("_k") + base).cast("int"), F.lit(-1)).alias("c0")
    )
    return Numbers(df, ("c0",), "int")


def translate(
    indexes: Numbers, tables: list[Numbers], base: int = 1, replacement: float | None = None
) -> list[Numbers]:
    """Rows of tables by index; a missing index gives the replacement, or the index itself."""
    out = []
    for t in tables:
        rows = t.df.select(F.col("_i").alias("_row"), *[F.col(c).alias(f"t{k}") for k, c in enumerate(t.columns)], F.lit(True).alias("_hit"))
        df = indexes.df
        cols = []
        for j, c in enumerate(indexes.columns):
            part = rows.select(*[F.col(n).alias(f"{n}_{j}") for n in rows.columns])
            df = df.join(part, F.col(c).cast("bigint") - base == F.col(f"_row_{j}"), "left")
            other = F.lit(float(replacement)) if replacement is not None else F.col(c).cast("double")
            cols += [
                to_kind(F.when(F.col(f"_hit_{j}"), F.col(f"t{k}_{j}").cast("double")).otherwise(other), t.kind)
                for k in range(t.block_length)
            ]
        out.append(Numbers(df.select("_i", *[e.alias(f"c{k}") for k, e in enumerate(cols)]), tuple(f"c{k}" for k in range(len(cols))), t.kind))
    return out


def distance(deltas: list[Column], metric: str, weights: list[float]) -> Column:
    """Weighted distance of column differences."""
    part = [w * d for w, d in zip(weights, deltas)]
    squares = sum((p * p for p in part), F.lit(0.0))
    absolute = sum((F.abs(p) for p in part), F.lit(0.0))
    n = float(len(part))
    return {
        "EUCLIDEAN": lambda: F.sqrt(squares),
        "NORMALIZED_EUCLIDEAN": lambda: F.sqrt(squares / n),
        "SUM_OF_SQUARES": lambda: squares,
        "MEAN_ABSOLUTE_DIFFERENCE": lambda: absolute / n,
        "SUM_OF_ABSOLUTE_DIFFERENCES": lambda: absolute,
        "MAX_ABSOLUTE_DIFFERENCE": lambda: F.greatest(*[F.abs(p) for p in part]) if len(part) > 1 else F.abs(part[0]),
    }[metric]()


#: Numbers of all centres that are broadcast: 16 MB of doubles.
MAX_CENTRES = 2_000_000


def nearest_centres(
    values: Numbers, centres: Numbers, metric: str = "NORMALIZED_EUCLIDEAN", weights: list[float] | None = None,
    max_distance: float | None = None, base: int = 1,
) -> Numbers:
    """index and distance of the nearest centre of every row; of equal ones the last wins; none gives -1, Infinity.

    The centres, a model, are one broadcast row that holds them as an array; each row of values folds over it, so
    rows neither shuffle nor multiply.  That they are at most MAX_CENTRES numbers is checked.
    """
    size = centres.df.limit(MAX_CENTRES // centres.block_length + 1).count() * centres.block_length
    if size > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} numbers of centres")
    weights = weights or [1.0] * values.block_length
    k = centres.block_length
    arrays = centres.df.select("_i", F.array(*[F.col(c).cast("double") for c in centres.columns]).alias("v"))
    # one row that holds all centres; their number is the model's, not the data's
    table = arrays.agg(F.sort_array(F.collect_list(F.struct("_i", "v"))).alias("_centres"))
    rows = values.df.crossJoin(F.broadcast(table))
    own = [F.col(c).cast("double") for c in values.columns]

    def far(c: Column) -> Column:
        return distance([own[j] - c["v"][j] for j in range(k)], metric, weights)

    start = F.struct(F.lit(-1).cast("bigint").alias("i"), F.lit(float("inf")).alias("d"))

    def closer(acc: Column, c: Column) -> Column:
        one = F.transform(F.array(far(c)), lambda d: F.when(
            (d <= acc["d"]) & (d <= F.lit(max_distance if max_distance is not None else float("inf"))),
            F.struct((c["_i"] + base).alias("i"), d.alias("d")),
        ).otherwise(acc))
        return one[0]

    best = rows.select("_i", F.aggregate("_centres", start, closer).alias("b"))
    return Numbers(best.select("_i", F.col("b.i").cast("int").alias("index"), F.col("b.d").alias("distance")), ("index", "distance"), "double")


def set_length(inputs: list[Numbers], low: int | None = None, high: int | None = None, filler: float = float("nan")) -> list[Numbers]:
    """Arrays padded or cut to the longest length, clamped to low..high."""
    n = max(x.df.agg(F.coalesce(F.max("_i") + 1, F.lit(0))).first()[0] for x in inputs)
    n = max(n, low or 0)
    n = min(n, high) if high is not None else n
    out = []
    for x in inputs:
        rows = x.df.sparkSession.range(n).withColumnRenamed("id", "_i").join(x.df.withColumn("_hit", F.lit(True)), "_i", "left")
        cols = [F.when(F.col("_hit"), F.col(c)).otherwise(to_kind(F.lit(filler), x.kind)).alias(c) for c in x.columns]
        out.append(Numbers(rows.select("_i", *cols), x.columns, x.kind))
    return out

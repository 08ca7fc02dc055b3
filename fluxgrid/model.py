"""Data model: number arrays, scalars and matrices as lazy DataFrames.

A number array is a DataFrame with the row position ``_i`` (0-based) and columns of one element kind.  A
matrix is a DataFrame with coordinates ``x, y`` and channels ``ch0..``, with its size and kind on the driver.
A scalar is text on the driver, or a text column where rows of scalars are processed.  ``None`` is the only
null: a port without a value.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.storage import stored

#: Spark type of each element kind; bytes and shorts are unsigned.
SPARK_TYPES = {
    "byte": "smallint",
    "short": "int",
    "int": "int",
    "long": "bigint",
    "float": "float",
    "double": "double",
    "boolean": "boolean",
}
#: Bounds of whole-number kinds.
BOUNDS = {
    "byte": (0, 255),
    "short": (0, 65535),
    "int": (-(1 << 31), (1 << 31) - 1),
    "long": (-(1 << 63), (1 << 63) - 1),
}
#: Largest value of a kind where values are normalised to 0..1.
MAX_POSSIBLE = {"boolean": 1, "byte": 255, "short": 65535, "int": (1 << 31) - 1, "float": 1, "double": 1}


def to_kind(value: Column, kind: str) -> Column:
    """Cast that truncates and saturates; NaN becomes 0 in whole-number kinds."""
    if kind not in BOUNDS:
        return value.cast(SPARK_TYPES[kind])
    low, high = BOUNDS[kind]
    d = value.cast("double")
    whole = d.cast(SPARK_TYPES[kind])
    return (
        F.when(F.isnan(d), F.lit(0).cast(SPARK_TYPES[kind]))
        .when(d <= F.lit(float(low)), F.lit(low).cast(SPARK_TYPES[kind]))
        .when(d >= F.lit(float(high)), F.lit(high).cast(SPARK_TYPES[kind]))
        .otherwise(whole)
    )


def extreme_of(values: list[Column], largest: bool) -> Column:
    """Largest or smallest of some columns; NaN if one of them is NaN."""
    if len(values) == 1:
        return values[0]
    if largest:  # NaN is the largest value of all
        return F.greatest(*values)
    broken = F.lit(False)
    for v in values:
        broken = broken | F.coalesce(F.isnan(v.cast("double")), F.lit(False))
    return F.when(broken, F.lit(float("nan"))).otherwise(F.least(*values))


@dataclass(frozen=True)
class Numbers:
    """A number array: ``df`` with ``_i`` and ``columns`` of one ``kind``.

    Elementwise results remember the frame they come from (``root``) and the selections since (``steps``), so
    arrays of one frame are put side by side by a projection.
    """

    df: DataFrame
    columns: tuple[str, ...]
    kind: str = "double"
    root: DataFrame | None = None
    steps: tuple[dict[str, Column], ...] = ()
    #: (part, (column, name) pairs) of arrays that were put side by side before the steps
    origin: tuple = ()

    @property
    def source(self) -> DataFrame:
        """Frame of which this array is a selection."""
        return self.df if self.root is None else self.root

    @property
    def block_length(self) -> int:
        """Numbers in a row."""
        return len(self.columns)

    def with_columns(self, exprs: dict[str, Column], kind: str | None = None) -> Numbers:
        """``_i`` and new columns by name."""
        kind = kind or self.kind
        df = self.df.select("_i", *[e.alias(n) for n, e in exprs.items()])
        return Numbers(df, tuple(exprs), kind, self.source, (*self.steps, dict(exprs)), self.origin)

    def map(self, f, kind: str | None = None) -> Numbers:
        """``f`` of every column, cast to ``kind``."""
        kind = kind or self.kind
        return self.with_columns({c: to_kind(f(F.col(c)), kind) for c in self.columns}, kind)

    def cast(self, kind: str) -> Numbers:
        """All columns in another kind."""
        return self if kind == self.kind else self.map(lambda c: c, kind)

    def renamed(self, prefix: str) -> Numbers:
        """Columns named by prefix and position."""
        return self.with_columns({f"{prefix}{k}": F.col(c) for k, c in enumerate(self.columns)})

    def slice(self, start: int = 0, length: int = 0) -> Numbers:
        """Columns from ``start``; ``length`` 0 goes to the end."""
        end = start + length if length else len(self.columns)
        if not 0 <= start < end <= len(self.columns):
            raise ValueError(f"columns {start}..{end} of {len(self.columns)}")
        return self.with_columns({c: F.col(c) for c in self.columns[start:end]})


def array(df: DataFrame, index: str, columns: list[str], kind: str = "double") -> Numbers:
    """A number array from a table that has a 0-based position column."""
    types = {c: to_kind(F.col(c), kind).alias(c) for c in columns}
    return Numbers(df.select(F.col(index).cast("bigint").alias("_i"), *types.values()), tuple(columns), kind)


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_i``: the position by ``keys``.

    Rows are dealt by ranges of all keys and sorted within their range; the table of places is stored, so ranges
    are fixed; rows then move by the sizes of the ranges before.  A range has about as many rows as any other
    unless rows are equal in all keys.
    """
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(
        ranged.select("*", F.shiftright(place, 33).cast("int").alias("_range"), place.bitwiseAND((1 << 33) - 1).alias("_place")),
        "ranges",
    )
    before = F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("_range").count().select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    # a row for each range, as many as there are shuffle partitions
    return rows.join(F.broadcast(starts), "_range").withColumn("_i", F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def literal_array(spark: SparkSession, rows: list[list[float]], kind: str = "double") -> Numbers:
    """A small array of given rows, without an RDD."""
    width = len(rows[0]) if rows else 1
    names = tuple(f"c{k}" for k in range(width))
    values = F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("_i"), *[F.lit(float(v)).alias(n) for n, v in zip(names, r)])
            for i, r in enumerate(rows)
        ]
    )
    if not rows:
        kinds = ", ".join(f"{n} {SPARK_TYPES[kind]}" for n in names)
        return Numbers(spark.createDataFrame([], f"_i bigint, {kinds}"), names, kind)
    return Numbers(spark.range(1).select(F.inline(values)), names, "double").cast(kind)


_numbers = itertools.count()


def rebuilt(frame: DataFrame, keys: list[str], carried: list[str], part) -> DataFrame:
    """The columns of a part beside carried ones, of which ``_source`` holds the row of the common frame."""
    if part.origin:
        done: list[str] = []
        names: list[str] = []
        for inner, pairs in part.origin:
            frame = rebuilt(frame, keys, [*carried, *done], inner)
            fresh = [f"_z{next(_numbers)}" for _ in pairs]
            frame = frame.select(*keys, *carried, *done, *[F.col(c).alias(z) for (c, _), z in zip(pairs, fresh)])
            done += fresh
            names += [name for _, name in pairs]
        frame = frame.select(*keys, *carried, *[F.col(z).alias(name) for z, name in zip(done, names)])
    else:
        rest = [c for c in part.source.columns if c not in keys]
        frame = frame.select(*keys, *carried, *[F.col("_source").getField(c).alias(c) for c in rest])
    for step in part.steps:
        frame = frame.select(*keys, *carried, *[e.alias(n) for n, e in step.items()])
    return frame


def side_by_side(parts: list, keys: list[str], outputs: list[list[tuple[str, str]]]) -> DataFrame:
    """Selections of one frame as one projection: ``outputs`` has (column, new name) pairs for each part."""
    source = parts[0].source
    rest = [F.col(c) for c in source.columns if c not in keys]
    frame = source.select(*keys, F.struct(*rest).alias("_source"))
    done: list[str] = []
    for part, pairs in zip(parts, outputs):
        frame = rebuilt(frame, keys, ["_source", *done], part)
        frame = frame.select(*keys, "_source", *done, *[F.col(c).alias(a) for c, a in pairs])
        done += [a for _, a in pairs]
    return frame.select(*keys, *done)


def joined(parts: list, keys: list[str], outputs: list[list[tuple[str, str]]]) -> DataFrame:
    """Parts side by side: those of one frame by a projection, different frames by a join on the keys."""
    groups: dict[int, list[int]] = {}
    for k, part in enumerate(parts):
        groups.setdefault(id(part.source), []).append(k)
    out = None
    for places in groups.values():
        frame = side_by_side([parts[k] for k in places], keys, [outputs[k] for k in places])
        out = frame if out is None else out.join(frame, keys)
    return out


def beside(*inputs: Numbers) -> tuple[Numbers, list[tuple[str, ...]]]:
    """One array of the columns of all inputs by position, and the new column names of each.

    Inputs that are selections of one frame need no join, and the result is a selection of it too.
    """
    names = [tuple(f"p{k}_{j}" for j in range(n.block_length)) for k, n in enumerate(inputs)]
    pairs = [list(zip(n.columns, own)) for n, own in zip(inputs, names)]
    df, flat = joined(list(inputs), ["_i"], pairs), tuple(c for own in names for c in own)
    if all(n.source is inputs[0].source for n in inputs):
        return Numbers(df, flat, inputs[0].kind, inputs[0].source, (), tuple(zip(inputs, pairs))), names
    return Numbers(df, flat, inputs[0].kind), names


def zipped(*inputs: Numbers) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """The frame of ``beside``, and the new column names of each input."""
    both, names = beside(*inputs)
    return both.df, names


@dataclass(frozen=True)
class Matrix:
    """A 2-D matrix: ``df`` with x, y and channels ch0..; 3-D ones also have z."""

    df: DataFrame
    dims: tuple[int, ...]
    channels: int
    kind: str = "byte"
    root: DataFrame | None = None
    steps: tuple[dict[str, Column], ...] = ()
    origin: tuple = ()

    @property
    def source(self) -> DataFrame:
        """Frame of which this matrix is a selection."""
        return self.df if self.root is None else self.root

    @property
    def axes(self) -> tuple[str, ...]:
        """Names of the coordinates."""
        return ("x", "y", "z")[: len(self.dims)]

    @property
    def names(self) -> list[str]:
        """Names of the channels."""
        return [f"ch{k}" for k in range(self.channels)]

    @property
    def top(self) -> int:
        """Largest value of the kind."""
        return MAX_POSSIBLE[self.kind]

    def of(self, exprs: list[Column], kind: str | None = None) -> Matrix:
        """Same pixels with new channels."""
        kind = kind or self.kind
        cols = {f"ch{k}": to_kind(e, kind) for k, e in enumerate(exprs)}
        df = self.df.select(*self.axes, *[e.alias(n) for n, e in cols.items()])
        return Matrix(df, self.dims, len(exprs), kind, self.source, (*self.steps, cols))

    def map(self, f, kind: str | None = None) -> Matrix:
        """``f`` of every channel."""
        return self.of([f(F.col(c)) for c in self.names], kind)


def grid(spark: SparkSession, width: int, height: int, exprs, kind: str = "byte") -> Matrix:
    """A matrix whose channels are expressions of x and y."""
    cells = spark.range(width * height).select(
        F.pmod("id", F.lit(width)).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y")
    )
    cols = [to_kind(e, kind).alias(f"ch{k}") for k, e in enumerate(exprs)]
    return Matrix(cells.select("x", "y", *cols), (width, height), len(cols), kind)


def paired(*inputs: Matrix) -> tuple[DataFrame, list[list[str]]]:
    """Matrices of equal size side by side, and the channel names of each; selections of one frame need no join."""
    first = inputs[0]
    if any(m.dims != first.dims for m in inputs):
        raise ValueError("matrices have different sizes")
    names = [[f"m{k}_{j}" for j in range(m.channels)] for k, m in enumerate(inputs)]
    pairs = [list(zip(m.names, own)) for m, own in zip(inputs, names)]
    return joined(list(inputs), list(first.axes), pairs), names

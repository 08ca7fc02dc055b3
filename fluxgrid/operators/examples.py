"""Small demonstration operators on arrays, scalars and matrices."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fluxgrid.model import Matrix, Numbers, grid, literal_array


def doubled(spark: SparkSession, x: Numbers | None = None) -> Numbers:
    """All numbers doubled; 1 to 5 where nothing is given."""
    if x is None:
        return literal_array(spark, [[float(k)] for k in range(1, 6)]).cast("float")
    return x.map(lambda c: c * 2)


def created(spark: SparkSession, width: int = 10, height: int = 10, channels: int = 1) -> Matrix:
    """Bytes that count up, each channel faster than the one before, and begin again after 255."""
    place = lambda c: (F.col("y") * width + F.col("x")) * channels + c
    return grid(spark, width, height, [F.pmod(place(c) * (c + 1), F.lit(256)) for c in range(channels)])


def increased(m: Matrix, increment: int = 50) -> Matrix:
    """Bytes increased modulo 256."""
    return m.map(lambda c: F.pmod(c.cast("int") + increment, F.lit(256)))


def function_of_place(spark: SparkSession, width: int = 1000, height: int = 1000, kind: str = "byte") -> Matrix:
    """Three channels in three bands of a function of x and y, cut to bytes modulo 256, in another precision."""
    from fluxgrid.operators.matrices import precision

    def channel(k: int):
        x, y = F.col("x").cast("double"), F.col("y").cast("double")
        middle = F.lit(0.0) if k else x / 2
        value = F.when(y < height / 4.0, x).when(y < height / 2.0, middle).otherwise(x * y * (k + 1) / 10.0)
        return F.pmod(F.floor(value), F.lit(256))

    return precision(grid(spark, width, height, [channel(k) for k in range(3)]), kind)


def sometimes_missing(m: Matrix | None, missing: bool = False) -> Matrix | None:
    """A matrix, or on demand nothing."""
    return None if missing else m

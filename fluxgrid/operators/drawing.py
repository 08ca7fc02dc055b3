"""Drawing on matrices: shapes are conditions on coordinates, so drawing is a projection."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxgrid.model import Matrix, to_kind
from fluxgrid.operators.matrices import colour, expanded, with_channels


def half_up(v: float) -> int:
    """Rounded half up."""
    return math.floor(v + 0.5)


def placed(m: Matrix, x: float, y: float, percents: bool) -> tuple[float, float]:
    """Coordinates, on demand as percents of the last pixel."""
    return (x / 100 * (m.dims[0] - 1), y / 100 * (m.dims[1] - 1)) if percents else (x, y)


def painted(m: Matrix, where: Column, fill: str, clear: bool = False, to_colour: bool = True) -> Matrix:
    """Pixels under a condition in a colour; others stay, or become zero."""
    shares = colour(fill)
    if to_colour and m.channels == 1 and len(shares) > 1 and len(set(shares[:3])) > 1:
        m = with_channels(m, 3)
    values = expanded(shares, m.channels)
    rest = [to_kind(F.lit(0.0), m.kind) if clear else F.col(c) for c in m.names]
    return m.of([F.when(where, to_kind(F.lit(v * m.top), m.kind)).otherwise(r) for v, r in zip(values, rest)])


def box(left: int, top: int, right: int, bottom: int) -> Column:
    """Inside a box, edges included."""
    return F.col("x").between(left, right) & F.col("y").between(top, bottom)


def rectangle(m: Matrix, left=0, top=0, width=100, height=100, thickness=0, fill="#FFFFFF", percents=False, clear=False) -> Matrix:
    """A filled box, or a frame of a thickness; negative places count from the end."""
    x, y = placed(m, left, top, percents)
    w, h = placed(m, width, height, percents)
    x, y = half_up(x), half_up(y)
    x, y = x + m.dims[0] if x < 0 else x, y + m.dims[1] if y < 0 else y
    right, bottom = x + half_up(w) - 1, y + half_up(h) - 1
    where = box(x, y, right, bottom)
    if thickness > 0:
        where = where & ~box(x + thickness, y + thickness, right - thickness, bottom - thickness)
    return painted(m, where, fill, clear)


def ellipse(m: Matrix, x=0, y=0, width=100, height=100, thickness=1, fill="#FFFFFF", percents=False, clear=False) -> Matrix:
    """An ellipse around a centre; thickness 0 or less fills it."""
    cx, cy = placed(m, x, y, percents)
    w, h = placed(m, width, height, percents)
    size = lambda a, b: F.pow((F.col("x") - cx) / a, 2) + F.pow((F.col("y") - cy) / b, 2)
    where = size(w / 2, h / 2) <= 1
    if thickness > 0 and w / 2 > thickness and h / 2 > thickness:
        where = where & (size(w / 2 - thickness, h / 2 - thickness) > 1)
    return painted(m, where, fill, clear)


def near_segment(x1: float, y1: float, x2: float, y2: float, width: float) -> Column:
    """Within half a width of a segment."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    px, py = F.col("x") - x1, F.col("y") - y1
    t = F.least(F.greatest((px * dx + py * dy) / square, F.lit(0.0)), F.lit(1.0)) if square else F.lit(0.0)
    return F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2) <= (width / 2) ** 2


def line(m: Matrix, x1=0, y1=0, x2=100, y2=100, thickness=1, increment=0.0, fill="#FFFFFF", percents=False, clear=False) -> Matrix:
    """A segment, longer by an increment around its centre."""
    (x1, y1), (x2, y2) = placed(m, x1, y1, percents), placed(m, x2, y2, percents)
    size = math.hypot(x2 - x1, y2 - y1)
    if size and increment:
        ex, ey = (x2 - x1) / size * increment / 2, (y2 - y1) / size * increment / 2
        x1, y1, x2, y2 = x1 - ex, y1 - ey, x2 + ex, y2 + ey
    return painted(m, near_segment(x1, y1, x2, y2, max(thickness, 1)), fill, clear)


def straight(m: Matrix, x=0, y=0, degrees=0.0, thickness=1, fill="#FFFFFF", percents=False, clear=False) -> Matrix:
    """An endless line through a point at an angle."""
    px, py = placed(m, x, y, percents)
    a = math.radians(degrees)
    off = (F.col("x") - px) * math.sin(a) - (F.col("y") - py) * math.cos(a)
    return painted(m, F.abs(off) <= max(thickness, 1) / 2, fill, clear)


def arrow(m: Matrix, x1=0, y1=0, x2=100, y2=100, thickness=1, length=20, width=5, fill="#FFFFFF", percents=False, clear=False) -> Matrix:
    """A segment with a filled triangular head at its end."""
    (x1, y1), (x2, y2) = placed(m, x1, y1, percents), placed(m, x2, y2, percents)
    size = math.hypot(x2 - x1, y2 - y1) or 1.0
    ux, uy = (x2 - x1) / size, (y2 - y1) / size
    along = (x2 - F.col("x")) * ux + (y2 - F.col("y")) * uy
    across = (F.col("x") - x2) * -uy + (F.col("y") - y2) * ux
    head = along.between(0, length) & (F.abs(across) <= along * (width / length))
    return painted(m, near_segment(x1, y1, x2, y2, max(thickness, 1)) | head, fill, clear)


def overlay(m: Matrix, image: Matrix, x: int = 0, y: int = 0, opacity: float = 1.0) -> Matrix:
    """Another matrix over this one at a place; alpha and opacity blend."""
    image = with_channels(image, max(image.channels, m.channels)) if image.channels < m.channels else image
    top = image.df.select(
        (F.col("x") + x).cast("int").alias("x"), (F.col("y") + y).cast("int").alias("y"),
        *[F.col(c).alias(f"t{k}") for k, c in enumerate(image.names)], F.lit(True).alias("_hit"),
    )
    alpha = F.lit(opacity) * (F.col("t3").cast("double") / float(image.top) if image.channels == 4 else F.lit(1.0))
    scale = m.top / image.top
    cols = [
        F.when(F.col("_hit"), to_kind(F.col(c).cast("double") * (1 - alpha) + F.col(f"t{k}").cast("double") * scale * alpha, m.kind))
        .otherwise(F.col(c))
        .alias(c)
        for k, c in enumerate(m.names)
    ]
    return replace(m, df=m.df.join(top, ["x", "y"], "left").select("x", "y", *cols))

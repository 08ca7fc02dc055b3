"""Matrix operators: channel expressions over (x, y) frames; geometry by coordinates; statistics by aggregation."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.model import MAX_POSSIBLE, Matrix, Numbers, extreme_of, paired, to_kind
from fluxgrid.operators.arithmetic import ANGLES, power_text

LUMA = (0.299, 0.587, 0.114)


def colour(text: str) -> list[float]:
    """#RRGGBB[AA], (0.5,1,1) normalised or [128,255,128] raw bytes, as shares of the largest value."""
    text = text.strip()
    if text.startswith("#"):
        return [int(text[k : k + 2], 16) / 255 for k in range(1, len(text), 2)]
    values = [float(v) for v in text[1:-1].split(",")]
    return values if text.startswith("(") else [v / 255 for v in values]


def expanded(shares: list[float], channels: int) -> list[float]:
    """A colour for a number of channels: grey by luma, alpha by 1."""
    if channels == 1 and len(shares) >= 3:
        return [sum(w * v for w, v in zip(LUMA, shares))]
    out = list(shares[:channels]) if len(shares) > 1 else shares * min(channels, 3)
    return out + [1.0] * (channels - len(out))


def luma(names: list[str], rounding: bool) -> Column:
    """Intensity of three channels."""
    out = sum((w * F.col(c).cast("double") for w, c in zip(LUMA, names)), F.lit(0.0))
    return F.floor(out + 0.5) if rounding else out


def intensity(m: Matrix) -> Matrix:
    """One channel of intensity."""
    if m.channels == 1:
        return m
    return m.of([luma(m.names, m.kind not in {"float", "double"})])


def with_channels(m: Matrix, n: int) -> Matrix:
    """Another number of channels: grey by intensity, more by replication, alpha full."""
    if n == m.channels:
        return m
    if n == 1:
        return intensity(m)
    colours = m.names if m.channels > 1 else m.names * 3
    cols = [F.col(colours[k]) if k < len(colours) else F.lit(float(m.top)) for k in range(n)]
    return m.of(cols)


def precision(m: Matrix, kind: str, raw: bool = False) -> Matrix:
    """Another element kind, values scaled to its range unless raw."""
    if raw or kind == m.kind:
        return m.map(lambda c: c.cast("double"), kind)
    scale = MAX_POSSIBLE[kind] / m.top
    if kind == "boolean":
        return m.map(lambda c: c != 0, kind)
    return m.map(lambda c: c.cast("double") * scale, kind)


def absolute(m: Matrix) -> Matrix:
    """|v|."""
    return m.map(lambda c: F.abs(c.cast("double")))


def inverted(m: Matrix, top: float = 1.0) -> Matrix:
    """top * largest - v."""
    return m.map(lambda c: F.lit(top * m.top) - c.cast("double"))


def cut(m: Matrix, low: float | None = None, high: float | None = None) -> Matrix:
    """Clamp to shares of the largest value."""

    def f(c: Column) -> Column:
        out = c.cast("double")
        out = F.greatest(out, F.lit(low * m.top)) if low is not None else out
        return F.least(out, F.lit(high * m.top)) if high is not None else out

    return m.map(f)


def combined(inputs: list[Matrix], f, kind: str | None = None) -> Matrix:
    """f of the channels of all inputs, channel by channel, in shares of the largest value if they are."""
    df, names = paired(*inputs)
    kind = kind or inputs[0].kind
    cols = [to_kind(f([F.col(own[k]).cast("double") for own in names]), kind).alias(f"ch{k}") for k in range(inputs[0].channels)]
    return Matrix(df.select(*inputs[0].axes, *cols), inputs[0].dims, inputs[0].channels, kind)


def linear(inputs: list[Matrix], a: list[float], b: float = 0.0, raw: bool = False, kind: str | None = None) -> Matrix:
    """a1 x1 + a2 x2 + ... + b."""
    shift = b if raw else b * inputs[0].top
    return combined(inputs, lambda vs: sum((v * w for v, w in zip(vs, a)), F.lit(float(shift))), kind)


def difference(x: Matrix, y: Matrix, operation: str = "ABSOLUTE_DIFFERENCE", multiplier: float = 1.0) -> Matrix:
    """One of five differences."""
    if operation == "RGB_DISTANCE":
        df, (a, b) = paired(x, y)
        square = sum((F.pow(F.col(p).cast("double") - F.col(q).cast("double"), 2) for p, q in zip(a, b)), F.lit(0.0))
        value = F.sqrt(square / x.channels) * multiplier
        return Matrix(df.select(*x.axes, to_kind(value, x.kind).alias("ch0")), x.dims, 1, x.kind)
    rules = {
        "ABSOLUTE_DIFFERENCE": lambda p, q: F.abs(p - q),
        "POSITIVE_DIFFERENCE": lambda p, q: F.greatest(p - q, F.lit(0.0)),
        "SUBTRACT": lambda p, q: p - q,
        "REVERSE_SUBTRACT": lambda p, q: q - p,
    }
    return combined([x, y], lambda v: rules[operation](*v) * multiplier)


def extreme(inputs: list[Matrix], largest: bool) -> Matrix:
    """Pixelwise maximum or minimum; NaN where one of the inputs is."""
    return inputs[0] if len(inputs) == 1 else combined(inputs, lambda v: extreme_of(v, largest))


def product_of_powers(x: Matrix, y: Matrix, a="1.0", b="1.0", m: float = 1.0) -> Matrix:
    """m x^a y^b of normalised values."""
    top = float(x.top)
    return combined([x, y], lambda v: F.pow(v[0] / top, F.lit(power_text(a))) * F.pow(v[1] / top, F.lit(power_text(b))) * (m * top))


def sum_of_powers(inputs: list[Matrix], power="2.0", power_of_sum="1.0 / 2.0", mode="MEAN", divider=1.0) -> Matrix:
    """(k sum |x|^p)^q of normalised values."""
    p, q, top = power_text(power), power_text(power_of_sum), float(inputs[0].top)
    k = {"SUM": 1.0, "MEAN": 1.0 / len(inputs), "CUSTOM_DIVIDER": 1.0 / divider}[mode]
    return combined(inputs, lambda vs: F.pow(sum((F.pow(F.abs(v / top), F.lit(p)) for v in vs), F.lit(0.0)) * k, F.lit(q)) * top)


def arctangent(x: Matrix, y: Matrix, angle_range: str = "ZERO_2PI_AS_0_1") -> Matrix:
    """Angle of a vector."""
    return combined([x, y], lambda v: ANGLES[angle_range](F.atan2(v[1], v[0])), "float")


def normalised_vector(x: Matrix, y: Matrix, zero: str = "X1_Y0") -> tuple[Matrix, Matrix, Matrix]:
    """x / |v|, y / |v| and |v|."""
    at_zero = {"ZERO": (0.0, 0.0), "X1_Y0": (1.0, 0.0), "X0_Y1": (0.0, 1.0), "NAN": (float("nan"),) * 2}[zero]
    size = lambda v: F.hypot(v[0], v[1])
    part = lambda k: combined([x, y], lambda v: F.when(size(v) == 0, F.lit(at_zero[k])).otherwise(F.try_divide(v[k], size(v))), "float")
    return part(0), part(1), combined([x, y], size, "float")


def non_zero(m: Matrix, invert: bool = False) -> Matrix:
    """Mask of pixels with any non-zero channel."""
    held = F.lit(False)
    for c in m.names[:3]:
        held = held | (F.col(c).cast("double") != 0)
    return m.of([~held if invert else held], "boolean")


def find_value(m: Matrix, kind: str = "EQUAL_TO_RAW_CUSTOM", value: float = 0.0) -> Matrix:
    """Mask of pixels whose channels all have (or not) a value."""
    tests = {
        "ZERO": lambda c: c == 0,
        "NON_ZERO": lambda c: c != 0,
        "NAN": F.isnan,
        "INFINITY": lambda c: F.abs(c) == float("inf"),
        "EQUAL_TO_RAW_CUSTOM": lambda c: c == value,
        "NONEQUAL_TO_RAW_CUSTOM": lambda c: c != value,
        "EQUAL_TO_NORMALIZED_CUSTOM": lambda c: c == value * m.top,
        "NONEQUAL_TO_NORMALIZED_CUSTOM": lambda c: c != value * m.top,
    }
    some = kind.startswith("NON")
    held = F.lit(not some)
    for c in m.names[:3]:
        one = tests[kind](F.col(c).cast("double"))
        held = held | one if some else held & one
    return m.of([held], "boolean")


def masked(m: Matrix, mask: Matrix, mode: str = "FILL_BACKGROUND", filler: str = "#000000") -> Matrix:
    """Pixels outside (or inside) a mask filled with a colour."""
    df, (own, held) = paired(m, mask)
    inside = F.col(held[0]).cast("double") != 0
    fill = inside if mode == "FILL_FOREGROUND" else ~inside
    shares = expanded(colour(filler), m.channels)
    cols = [F.when(fill, to_kind(F.lit(s * m.top), m.kind)).otherwise(F.col(c)).alias(n) for s, c, n in zip(shares, own, m.names)]
    return Matrix(df.select(*m.axes, *cols), m.dims, m.channels, m.kind)


def filled(m: Matrix, left: int, top: int, right: int, bottom: int, fill: str = "#00FF00") -> Matrix:
    """A box of pixels (inclusive) filled with a colour."""
    box = F.col("x").between(left, right) & F.col("y").between(top, bottom)
    shares = expanded(colour(fill), m.channels)
    cols = [F.when(box, to_kind(F.lit(s * m.top), m.kind)).otherwise(F.col(c)) for s, c in zip(shares, m.names)]
    return m.of(cols)


def channel_group(m: Matrix, first: int, count: int) -> Matrix:
    """A slice of channels; those that are missing hold zero."""
    return m.of([F.col(m.names[k]) if k < m.channels else F.lit(0.0) for k in range(first, first + count)]) if count else m


def merge_channels(inputs: list[Matrix]) -> Matrix:
    """Channels of several matrices in one."""
    df, names = paired(*inputs)
    flat = [a for own in names for a in own]
    cols = [to_kind(F.col(a), inputs[0].kind).alias(f"ch{k}") for k, a in enumerate(flat)]
    return Matrix(df.select(*inputs[0].axes, *cols), inputs[0].dims, len(cols), inputs[0].kind)


def split_channels(m: Matrix) -> list[Matrix]:
    """One matrix for each channel."""
    return [m.of([F.col(c)]) for c in m.names]


def merge_masks(masks: list[Matrix]) -> Matrix:
    """Number of the last mask that holds a pixel, else 0."""
    df, names = paired(*masks)
    label = F.lit(0)
    for k, own in enumerate(names, 1):
        label = F.when(F.col(own[0]).cast("double") != 0, F.lit(k)).otherwise(label)
    return Matrix(df.select(*masks[0].axes, label.alias("ch0")), masks[0].dims, 1, "int")


def selected(selector: Matrix, inputs: list[Matrix]) -> Matrix:
    """Pixel of the input that an integer selector names."""
    df, names = paired(selector, *inputs)
    pick = F.col(names[0][0])
    cols = []
    for k in range(inputs[0].channels):
        value = F.lit(None)
        for j, own in enumerate(names[1:]):
            value = F.when(pick == j, F.col(own[k])).otherwise(value)
        cols.append(F.coalesce(value.cast("double"), F.lit(0.0)))
    out = [to_kind(c, inputs[0].kind).alias(f"ch{k}") for k, c in enumerate(cols)]
    return Matrix(df.select(*selector.axes, *out), selector.dims, len(out), inputs[0].kind)


def equality(x: Matrix, y: Matrix, mode: str = "E0_NY") -> Matrix:
    """By pixel: the first two characters name the value where all channels are equal, the last two where not; NaN equals nothing."""
    df, (a, b) = paired(x, y)
    same = F.lit(True)
    for p, q in zip(a, b):
        same = same & (F.col(p).cast("double") == F.col(q).cast("double")) & ~F.isnan(F.col(p).cast("double"))
    value = {"0": lambda k: F.lit(0.0), "1": lambda k: F.lit(float(x.top)), "X": lambda k: F.col(a[k]), "Y": lambda k: F.col(b[k])}
    equal, other = mode[1], mode[-1]
    cols = [F.when(same, value[equal](k).cast("double")).otherwise(value[other](k).cast("double")) for k in range(x.channels)]
    return Matrix(df.select(*x.axes, *[to_kind(c, x.kind).alias(f"ch{k}") for k, c in enumerate(cols)]), x.dims, x.channels, x.kind)


def moved(coordinate: Column, size: int, mode: str) -> Column:
    """Coordinate in the source of a place that may lie outside."""
    if mode in {"CYCLIC", "PSEUDO_CYCLIC", "DEFAULT"}:
        return F.pmod(coordinate, F.lit(size))
    if mode == "MIRROR_CYCLIC":
        wave = F.pmod(coordinate, F.lit(2 * size))
        return F.when(wave < size, wave).otherwise(2 * size - 1 - wave)
    return coordinate


CONSTANTS = {"ZERO_CONSTANT": 0.0, "POSITIVE_INFINITY": float("inf"), "NEGATIVE_INFINITY": float("-inf"), "NAN_CONSTANT": float("nan")}


def cropped(m: Matrix, left: int, top: int, width: int, height: int, mode: str = "CYCLIC") -> Matrix:
    """A box that may go beyond the matrix, continued by a mode."""
    spark = m.df.sparkSession
    inner = m.df.where(F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1))
    if left >= 0 and top >= 0 and left + width <= m.dims[0] and top + height <= m.dims[1]:
        df = inner.select((F.col("x") - left).alias("x"), (F.col("y") - top).alias("y"), *m.names)
        return replace(m, df=df, dims=(width, height))
    cells = spark.range(width * height).select(
        F.pmod("id", F.lit(width)).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y")
    )
    cells = cells.withColumn("sx", moved(F.col("x") + left, m.dims[0], mode)).withColumn("sy", moved(F.col("y") + top, m.dims[1], mode))
    source = m.df.select(F.col("x").alias("sx"), F.col("y").alias("sy"), *m.names)
    other = to_kind(F.lit(CONSTANTS.get(mode, 0.0)), m.kind)
    df = cells.join(source, ["sx", "sy"], "left").select("x", "y", *[F.coalesce(F.col(c), other).alias(c) for c in m.names])
    return replace(m, df=df, dims=(width, height))


def shifted(m: Matrix, dx: int, dy: int, mode: str = "CYCLIC") -> Matrix:
    """The matrix moved by (dx, dy)."""
    if mode in {"CYCLIC", "DEFAULT", "PSEUDO_CYCLIC"}:
        x, y = F.pmod(F.col("x") + dx, F.lit(m.dims[0])), F.pmod(F.col("y") + dy, F.lit(m.dims[1]))
        return replace(m, df=m.df.select(x.cast("int").alias("x"), y.cast("int").alias("y"), *m.names))
    return cropped(m, -dx, -dy, m.dims[0], m.dims[1], mode)


RESIZING = ("NEAREST", "AVERAGING", "BILINEAR", "AVERAGING_BILINEAR", "AVERAGING_MIN", "AVERAGING_MAX")


def axis_sources(spark, new: int, old: int, mode: str, axis: str) -> DataFrame:
    """(axis, s<axis>, w<axis>): the old places that make up each new place of one axis, with whole-number weights."""
    p = F.col("id")
    div = lambda a, n: F.floor(a / F.lit(n))
    if mode == "NEAREST" or ("BILINEAR" not in mode and new >= old):
        parts = F.array(F.struct(div((2 * p + 1) * old, 2 * new).alias("s"), F.lit(1).cast("long").alias("w")))
    elif mode == "BILINEAR" or ("BILINEAR" in mode and new >= old):
        # the centre of the new place among the centres of the old ones, in parts of 2 * new
        at = F.least(F.greatest((2 * p + 1) * old - new, F.lit(0)), F.lit((old - 1) * 2 * new))
        low, part = div(at, 2 * new), F.pmod(at, F.lit(2 * new))
        parts = F.array(
            F.struct(low.alias("s"), (2 * new - part).cast("long").alias("w")),
            F.struct((low + 1).alias("s"), part.cast("long").alias("w")),
        )
    elif mode == "AVERAGING_BILINEAR":
        # how much of each old place the new one covers, in parts of new
        shared = lambda s: F.least((s + 1) * new, (p + 1) * old) - F.greatest(s * new, p * old)
        covered = F.sequence(div(p * old, new), div((p + 1) * old + new - 1, new) - 1)
        parts = F.transform(covered, lambda s: F.struct(s.alias("s"), shared(s).cast("long").alias("w")))
    else:
        block = F.sequence(div(p * old + new - 1, new), div((p + 1) * old + new - 1, new) - 1)
        parts = F.transform(block, lambda s: F.struct(s.alias("s"), F.lit(1).cast("long").alias("w")))
    rows = spark.range(new).select(p.cast("int").alias(axis), F.explode(parts).alias("part"))
    return rows.select(axis, F.col("part.s").cast("int").alias(f"s{axis}"), F.col("part.w").alias(f"w{axis}")).where(
        F.col(f"w{axis}") > 0
    )


def percent_size(m: Matrix, width: float | None, height: float | None, percents: bool) -> tuple[int, int]:
    """Sizes in pixels, given in pixels or percents; a missing one keeps the aspect."""
    w, h = m.dims[:2]
    if width is None and height is None:
        raise ValueError("no size")
    if percents:
        width, height = (None if v is None else v * n / 100 for v, n in ((width, w), (height, h)))
    width = height * w / h if width is None else width
    height = width * h / w if height is None else height
    return max(1, math.floor(width + 0.5)), max(1, math.floor(height + 0.5))


def resized(m: Matrix, width: float | None, height: float | None, mode: str = "AVERAGING", percents: bool = False) -> Matrix:
    """Another size in pixels or percents, axis by axis; a missing size keeps the aspect.

    Where an axis grows, the averaging modes take the nearest pixel; where it shrinks, the mean, least or largest of a
    block.  BILINEAR interpolates between pixel centres on both axes; AVERAGING_BILINEAR does so where an axis grows and
    takes the mean by covered area where it shrinks.
    """
    if mode not in RESIZING:
        raise ValueError(f"unknown resizing mode {mode}")
    width, height = percent_size(m, width, height, percents)
    w, h = m.dims[:2]
    reduce = {"AVERAGING_MIN": F.min, "AVERAGING_MAX": F.max}.get(mode, F.avg)
    if mode != "NEAREST" and "BILINEAR" not in mode and width <= w and height <= h:
        block = [F.floor(F.col("x") * width / w).cast("int").alias("x"), F.floor(F.col("y") * height / h).cast("int").alias("y")]
        found = m.df.groupBy(*block).agg(*[reduce(F.col(c).cast("double")).alias(c) for c in m.names])
    else:
        spark = m.df.sparkSession
        source = m.df.select(F.col("x").alias("sx"), F.col("y").alias("sy"), *m.names)
        cells = source.join(axis_sources(spark, width, w, mode, "x"), "sx").join(axis_sources(spark, height, h, mode, "y"), "sy")
        if mode == "NEAREST" or ("BILINEAR" not in mode and width >= w and height >= h):
            return replace(m, df=cells.select("x", "y", *m.names), dims=(width, height))
        weight = F.col("wx") * F.col("wy")
        mean = lambda v: F.sum(v * weight) / F.sum(weight)
        found = cells.groupBy("x", "y").agg(
            *[(mean if reduce is F.avg else reduce)(F.col(c).cast("double")).alias(c) for c in m.names]
        )
    whole = m.kind not in {"float", "double"}
    cols = [to_kind(F.floor(F.col(c) + 0.5) if whole else F.col(c), m.kind).alias(c) for c in m.names]
    return replace(m, df=found.select("x", "y", *cols), dims=(width, height))


def layer(m: Matrix, z: int) -> Matrix:
    """One layer of a 3-D matrix; negative numbers count from the end."""
    z = z + m.dims[2] if z < 0 else z
    return Matrix(m.df.where(F.col("z") == z).drop("z"), m.dims[:2], m.channels, m.kind)


def interpolated(front: Matrix, rear: Matrix, n: int) -> Matrix:
    """n layers between two matrices."""
    df, (a, b) = paired(front, rear)
    layers = df.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = F.col("z") / float(max(n - 1, 1))
    cols = [to_kind(F.col(p) * (1 - t) + F.col(q) * t, front.kind).alias(f"ch{k}") for k, (p, q) in enumerate(zip(a, b))]
    return Matrix(layers.select("x", "y", "z", *cols), (*front.dims, n), front.channels, front.kind)


def flattened(m: Matrix) -> Matrix:
    """The last two dimensions of a 3-D matrix in one."""
    y = (F.col("z") * m.dims[1] + F.col("y")).cast("int")
    return Matrix(m.df.select("x", y.alias("y"), *m.names), (m.dims[0], m.dims[1] * m.dims[2]), m.channels, m.kind)


def dilated(m: Matrix, size: int) -> Matrix:
    """Largest value in a square of odd size around each pixel, one axis after the other, by windows along lines."""
    r = size // 2
    df = m.df
    for line, along in (("y", "x"), ("x", "y")):
        near = Window.partitionBy(line).orderBy(along).rangeBetween(-r, r)
        df = df.select("x", "y", *[F.max(c).over(near).alias(c) for c in m.names])
    return replace(m, df=df)


def info(m: Matrix) -> DataFrame:
    """A row for each channel: mean, sum, extremes, range of non-zero values, first places of the extremes."""
    channels = F.posexplode(F.array(*[F.col(c).cast("double") for c in m.names])).alias("channel", "v")
    place = F.col("y").cast("bigint") * m.dims[0] + F.col("x")
    rows = m.df.select(place.alias("place"), channels)
    real = F.when(F.col("v") != 0, F.col("v"))
    return rows.groupBy("channel").agg(
        F.avg("v").alias("mean"),
        F.sum("v").alias("sum"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.min(F.struct("v", "place"))["place"].alias("min_position"),
        (-F.max(F.struct(F.col("v"), (-F.col("place")).alias("p")))["p"]).alias("max_position"),
        F.min(real).alias("least_non_zero"),
        F.count(real).alias("non_zero"),
    )


def hsv(m: Matrix) -> list[Column]:
    """Hue, saturation and value of red, green and blue, in 0..1."""
    r, g, b = [F.col(c).cast("double") / float(m.top) for c in m.names[:3]]
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    part = lambda p, q, turn: (F.try_divide(p - q, d) + turn) / 6.0
    hue = F.when(d == 0, F.lit(0.0)).when(top == r, part(g, b, 0.0)).when(top == g, part(b, r, 2.0)).otherwise(part(r, g, 4.0))
    hue = F.when(hue < 0, hue + 1).otherwise(hue)
    return [hue, F.when(top == 0, F.lit(0.0)).otherwise(F.try_divide(d, top)), top]


def split_hsv(m: Matrix) -> Matrix:
    """Channels hue, saturation and value as float."""
    return m.of(hsv(m), "float")


def pixels(m: Matrix) -> Numbers:
    """Rows of channels in the order of lines."""
    place = (F.col("y").cast("bigint") * m.dims[0] + F.col("x")).alias("_i")
    return Numbers(m.df.select(place, *m.names), tuple(m.names), m.kind)


def bilinear(spark, width: int, height: int, cx2=0.001, cxy=0.0002, cy2=0.001, cx=0.0, cy=0.0, c=0.0, origin=(0.0, 0.0)) -> Matrix:
    """cx2 dx^2 + 2 cxy dx dy + cy2 dy^2 + cx dx + cy dy + c, as float."""
    from fluxgrid.model import grid

    dx, dy = F.col("x") - origin[0], F.col("y") - origin[1]
    return grid(spark, width, height, [dx * dx * cx2 + dx * dy * (2 * cxy) + dy * dy * cy2 + dx * cx + dy * cy + c], "float")

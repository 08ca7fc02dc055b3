"""Matrix operators on vectors, colour spaces, contrast and statistics under a mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.model import Matrix, paired, to_kind
from fluxgrid.operators.matrices import combined, difference, info


def angle_difference(x1: Matrix, y1: Matrix, x2: Matrix, y2: Matrix, metric: str = "R_SIN") -> Matrix:
    """Metrics of the angle of two vectors from their cross and dot products.

    SIN is the normalised cross product; R_ multiplies by the root of the sizes' product, R_R_ by the product;
    COS adds the dot product, SIGNUM_COS its sign.
    """
    df, names = paired(x1, y1, x2, y2)
    a, b, c, d = [F.col(own[0]).cast("double") for own in names]
    cross, dot = F.abs(a * d - b * c), a * c + b * d
    size = F.sqrt((a * a + b * b) * (c * c + d * d))
    part = lambda v: F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(v, size))
    tail = metric.split("SIN")[1]
    scale = {"": F.lit(1.0), "R_": F.sqrt(size), "R_R_": size}[metric.split("SIN")[0]]
    value = part(cross)
    if tail == "_COS":
        value = F.when(dot < 0, 2 - value).otherwise(value)
    elif tail == "_SIGNUM_COS":
        value = F.when(dot < 0, F.lit(1.0)).otherwise(value)
    return Matrix(df.select(*x1.axes, (value * scale).cast("float").alias("ch0")), x1.dims, 1, "float")


def double_angle(x: Matrix, y: Matrix, zero: str = "X1_Y0", normalised_result: bool = False) -> tuple[Matrix, Matrix]:
    """r cos 2f and r sin 2f of a vector, or without r."""
    at_zero = {"ZERO": (0.0, 0.0), "X1_Y0": (1.0, 0.0), "X0_Y1": (0.0, 1.0), "NAN": (float("nan"),) * 2}[zero]

    def part(k: int) -> Matrix:
        def f(v: list[Column]) -> Column:
            r = F.hypot(v[0], v[1])
            top = v[0] * v[0] - v[1] * v[1] if k == 0 else 2 * v[0] * v[1]
            return F.when(r == 0, F.lit(at_zero[k])).otherwise(F.try_divide(top, r * r if normalised_result else r))

        return combined([x, y], f, "float")

    return part(0), part(1)


def difference_from_pair(x: Matrix, a: Matrix, b: Matrix, operation: str = "RGB_DISTANCE_SQUARE_DIVIDED_BY_SUM") -> Matrix:
    """|x - a| against |x - b| by colour distance."""
    df, names = paired(x, a, b)
    far = lambda own: sum((F.pow(F.col(p).cast("double") - F.col(q).cast("double"), 2) for p, q in zip(names[0], own)), F.lit(0.0))
    p, q = F.sqrt(far(names[1]) / x.channels), F.sqrt(far(names[2]) / x.channels)
    safe = lambda u, v: F.coalesce(F.try_divide(u, v), F.lit(0.0))
    value = {
        "RGB_DISTANCE_RELATION": lambda: safe(p, q),
        "RGB_DISTANCE_SQUARE_DIVIDED_BY_SUM": lambda: safe(p * p, p + q),
        "RGB_DISTANCE_DIVIDED_BY_SUM": lambda: safe(p, p + q),
    }[operation]()
    return Matrix(df.select(*x.axes, value.cast("float").alias("ch0")), x.dims, 1, "float")


def difference_info(x: Matrix, y: Matrix, operation: str = "ABSOLUTE_DIFFERENCE") -> DataFrame:
    """Statistics of a difference matrix."""
    return info(difference(x, y, operation))


def from_hsv(m: Matrix, kind: str = "byte") -> Matrix:
    """Red, green and blue of hue, saturation and value in 0..1."""
    from fluxgrid.model import MAX_POSSIBLE

    h, s, v = [F.col(c).cast("double") for c in m.names[:3]]
    top = float(MAX_POSSIBLE[kind])

    def part(n: float) -> Column:
        k = F.pmod(F.lit(n) + h * 6, F.lit(6.0))
        value = v - v * s * F.greatest(F.least(k, 4 - k, F.lit(1.0)), F.lit(0.0))
        return F.floor(value * top + 0.5) if top > 1 else value

    return m.of([part(5.0), part(3.0), part(1.0)], kind)


def split_hls(m: Matrix) -> Matrix:
    """Channels hue, lightness and saturation as float."""
    from fluxgrid.operators.matrices import hsv

    r, g, b = [F.col(c).cast("double") / float(m.top) for c in m.names[:3]]
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    lightness = (top + low) / 2
    width = F.when(lightness <= 0.5, top + low).otherwise(2 - top - low)
    saturation = F.when(top == low, F.lit(0.0)).otherwise(F.try_divide(top - low, width))
    return m.of([hsv(m)[0], lightness, saturation], "float")


def from_hls(m: Matrix, kind: str = "byte") -> Matrix:
    """Red, green and blue of hue, lightness and saturation in 0..1."""
    from fluxgrid.model import MAX_POSSIBLE

    h, light, s = [F.col(c).cast("double") for c in m.names[:3]]
    top = float(MAX_POSSIBLE[kind])
    span = s * F.least(light, 1 - light)

    def part(n: float) -> Column:
        k = F.pmod(F.lit(n) + h * 12, F.lit(12.0))
        value = light - span * F.greatest(F.least(k - 3, 9 - k, F.lit(1.0)), F.lit(-1.0))
        return F.floor(value * top + 0.5) if top > 1 else value

    return m.of([part(0.0), part(8.0), part(4.0)], kind)


def split_colours(m: Matrix, space: str = "RGB") -> list[Matrix]:
    """One matrix for each channel of a colour space."""
    from fluxgrid.operators.matrices import split_channels, split_hsv

    return split_channels({"RGB": lambda x: x, "HSV": split_hsv, "HLS": split_hls}[space](m))


def merge_colours(inputs: list[Matrix], space: str = "RGB", kind: str = "byte") -> Matrix:
    """A colour matrix of the channels of a colour space."""
    from fluxgrid.operators.matrices import merge_channels

    m = merge_channels(inputs)
    return m if space == "RGB" else {"HSV": from_hsv, "HLS": from_hls}[space](m, kind)


LIMITS = ("PERCENTILE_BETWEEN_MIN_AND_MAX", "VALUE_BETWEEN_MIN_AND_MAX", "ABSOLUTE_VALUE")


def contrast(
    m: Matrix, low: float = 0.0, high: float = 1.0, low_kind: str = LIMITS[0], high_kind: str = LIMITS[0], by_channel: bool = False
) -> Matrix:
    """The range between two limits of the intensity stretched to the whole range.

    A limit is a percentile, a share between the least and the largest intensity, or an absolute value as a share of
    the largest possible one.  Colours keep their hue: all channels of a pixel grow by the ratio of its new and its
    old intensity, unless channels are to be stretched one by one.
    """
    from fluxgrid.operators.matrices import intensity, luma, pixels
    from fluxgrid.operators.statistics import percentiles

    grey = pixels(intensity(m))
    v = F.col(grey.columns[0]).cast("double")
    least, most = grey.df.agg(F.min(v), F.max(v)).first()

    def limit(kind: str, share: float) -> float:
        if kind == "ABSOLUTE_VALUE":
            return share * m.top
        if kind == "VALUE_BETWEEN_MIN_AND_MAX":
            return least + (most - least) * share
        return percentiles(grey, [share]).first()["value"]

    a, b = limit(low_kind, low), limit(high_kind, high)
    if a == b:
        return m

    def stretched(c: Column) -> Column:
        value = (c.cast("double") - a) * (m.top / (b - a))
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(float(m.top)))

    whole = (lambda c: F.floor(c + 0.5)) if m.kind not in {"float", "double"} else (lambda c: c)
    if m.channels < 3 or by_channel:
        return m.map(lambda c: whole(stretched(c)))
    old = luma(m.names[:3], False)
    ratio = F.when(old == 0, F.lit(0.0)).otherwise(stretched(old) / old)
    colours = [whole(F.least(F.col(c).cast("double") * ratio, F.lit(float(m.top)))) for c in m.names[:3]]
    return m.of([*colours, *[F.col(c) for c in m.names[3:]]])


def image_histogram(m: Matrix, mask: Matrix | None = None, bins: int = 256, kind: str = "UNIFORM_256") -> DataFrame:
    """channel, bin, n under a mask: bins over the whole range of the kind, or (RANGE_BASED) over least to largest."""
    if mask is not None:
        df, names = paired(m, mask)
        rows, own = df.where(F.col(names[1][0]).cast("double") != 0), names[0]
    else:
        rows, own = m.df, m.names
    flat = rows.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in own])).alias("channel", "v"))
    if kind == "UNIFORM_256":
        bins, ends = 256, None
        place = F.least(F.floor(F.col("v") * (256.0 / (m.top + (1 if m.top > 1 else 0)))), F.lit(255))
    else:
        ends = flat.groupBy("channel").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        # a row for each channel
        flat = flat.join(F.broadcast(ends), "channel")
        width = (F.col("high") - F.col("low")) / bins
        place = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), width)), F.lit(bins - 1)))
    found = flat.groupBy("channel", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    spark = m.df.sparkSession
    every = spark.range(m.channels * bins).select(F.floor(F.col("id") / bins).cast("int").alias("channel"), F.pmod("id", F.lit(bins)).cast("int").alias("bin"))
    return every.join(found, ["channel", "bin"], "left").select("channel", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def image_statistics(m: Matrix, mask: Matrix | None = None, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """By channel under a mask: count, mean, two percentiles and the mean between them.

    Values are counted first; windows run over distinct values of a channel, at most those of its kind.
    """
    if mask is not None:
        df, names = paired(m, mask)
        rows = df.where(F.col(names[1][0]).cast("double") != 0)
        own = names[0]
    else:
        rows, own = m.df, m.names
    flat = rows.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in own])).alias("channel", "v"))
    counts = flat.groupBy("channel", "v").agg(F.count("*").alias("n"))
    by_value = Window.partitionBy("channel").orderBy("v")
    ranked = counts.select(
        "channel", "v", "n", F.sum("n").over(by_value).alias("up_to"), F.sum("n").over(Window.partitionBy("channel")).alias("total")
    )
    place = lambda p: F.floor(F.col("total") * p)
    first = lambda p: F.min(F.when(F.col("up_to") > F.least(place(p), F.col("total") - 1), F.col("v")))
    limits = ranked.groupBy("channel").agg(first(low).alias("percentile_1"), first(high).alias("percentile_2"))
    between = F.col("v").between(F.col("percentile_1"), F.col("percentile_2"))
    return (
        ranked.join(limits, "channel")
        .groupBy("channel", "percentile_1", "percentile_2")
        .agg(
            F.sum("n").alias("number_of_checked_pixels"),
            (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
            (F.sum(F.when(between, F.col("v") * F.col("n"))) / F.sum(F.when(between, F.col("n")))).alias("mean_between_percentiles"),
        )
    )


def double_kind(m: Matrix) -> Matrix:
    """Channels as double."""
    return m.of([to_kind(F.col(c), "double") for c in m.names], "double")

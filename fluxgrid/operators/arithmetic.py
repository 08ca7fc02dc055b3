"""Elementwise operators of number arrays: column expressions, zipped by position where inputs differ."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxgrid.model import Numbers, beside, extreme_of, to_kind, zipped


def wide(*inputs: Numbers) -> str:
    """double if the first input is double, else float."""
    return "double" if inputs[0].kind == "double" else "float"


def power_text(text: str | float) -> float:
    """A number, or "p / q"."""
    if isinstance(text, str) and "/" in text:
        p, q = text.split("/")
        return float(p) / float(q)
    return float(text)


def ieee(test: Column, *values: Column) -> Column:
    """A comparison that is false when a value is NaN."""
    out = test
    for v in values:
        out = out & ~F.isnan(v.cast("double"))
    return out


def within(v: Column, low: float | None, high: float | None) -> Column:
    """low <= v <= high without NaN; a missing bound is open."""
    out = ~F.isnan(v.cast("double"))
    if low is not None:
        out = out & (v >= F.lit(low))
    if high is not None:
        out = out & (v <= F.lit(high))
    return out


def absolute(x: Numbers) -> Numbers:
    """|x| as float."""
    return x.map(F.abs, "float")


def negated(x: Numbers) -> Numbers:
    """-x as float."""
    return x.map(lambda c: -c.cast("double"), "float")


def replace_nan(x: Numbers, value: float = 0.0) -> Numbers:
    """NaN replaced, as float."""
    return x.map(lambda c: F.nanvl(c.cast("double"), F.lit(value)), "float")


def pairwise(x: Numbers, y: Numbers | None, f, kind: str) -> Numbers:
    """f of the columns of x and y in turn (y may be None)."""
    if y is None:
        return x.with_columns({c: to_kind(f(F.col(c), None), kind) for c in x.columns}, kind)
    if x.block_length != y.block_length:
        raise ValueError("different block lengths")
    both, (a, b) = beside(x, y)
    return both.with_columns({c: to_kind(f(F.col(p), F.col(q)), kind) for c, p, q in zip(x.columns, a, b)}, kind)


def linear(
    x: Numbers, y: Numbers | None = None, a: float = 1.0, b: float = 1.0, summand: float = 0.0, absolute_value=False
) -> Numbers:
    """a x + b y + summand."""

    def f(p: Column, q: Column | None) -> Column:
        out = p.cast("double") * a
        out = (out if q is None else out + q.cast("double") * b) + summand
        return F.abs(out) if absolute_value else out

    return pairwise(x, y, f, wide(x))


def difference(x: Numbers, y: Numbers, operation: str = "ABSOLUTE_DIFFERENCE", kind: str = "float") -> Numbers:
    """One of five differences."""
    zero = F.lit(0.0)
    rules = {
        "ABSOLUTE_DIFFERENCE": lambda p, q: F.abs(p - q),
        "POSITIVE_DIFFERENCE": lambda p, q: F.greatest(p - q, zero),
        "REVERSE_POSITIVE_DIFFERENCE": lambda p, q: F.greatest(q - p, zero),
        "SUBTRACT": lambda p, q: p - q,
        "REVERSE_SUBTRACT": lambda p, q: q - p,
    }
    return pairwise(x, y, lambda p, q: rules[operation](p.cast("double"), q.cast("double")), kind)


def equality(x: Numbers, y: Numbers, true=1.0, false=0.0, invert=False, kind: str = "float") -> Numbers:
    """true where elements are equal; longs exactly, other pairs as double without NaN."""

    def f(p: Column, q: Column) -> Column:
        if x.kind == y.kind == "long":
            same = p == q
        else:
            same = ieee(p.cast("double") == q.cast("double"), p, q)
        return F.when(~same if invert else same, F.lit(float(true))).otherwise(F.lit(float(false)))

    return pairwise(x, y, f, kind)


def extreme(inputs: list[Numbers | None], largest: bool) -> Numbers:
    """Elementwise maximum or minimum of the given inputs; NaN where one of them is."""
    given = [n for n in inputs if n is not None]
    if not given:
        raise ValueError("no input")
    if len(given) == 1:
        return given[0]
    both, names = beside(*given)
    kind = given[0].kind
    cols = [to_kind(extreme_of([F.col(own[k]) for own in names], largest), kind) for k in range(given[0].block_length)]
    return both.with_columns(dict(zip(given[0].columns, cols)), kind)


def base_value(base: str, custom: float) -> float:
    """Base by name."""
    return {"BASE_10": 10.0, "BASE_E": math.e, "CUSTOM": custom}[base]


def exponent(x: Numbers, base: str = "BASE_E", custom: float = 2.0) -> Numbers:
    """base ^ x."""
    f = (lambda c: F.exp(c.cast("double"))) if base == "BASE_E" else (
        lambda c: F.pow(F.lit(base_value(base, custom)), c.cast("double"))
    )
    return x.map(f, wide(x))


def logarithm(x: Numbers, base: str = "BASE_E", custom: float = 2.0) -> Numbers:
    """Logarithm; 0 gives -Infinity, less gives NaN."""

    def f(c: Column) -> Column:
        d = c.cast("double")
        log = F.ln(d) if base == "BASE_E" else F.log10(d) if base == "BASE_10" else F.ln(d) / math.log(custom)
        return F.when(F.isnan(d) | (d < 0), F.lit(float("nan"))).when(d == 0, F.lit(float("-inf"))).otherwise(log)

    return x.map(f, wide(x))


def in_range(
    x: Numbers,
    low: float | None = None,
    high: float | None = None,
    true=1.0,
    false=0.0,
    invert=False,
    add_true_to_index=False,
    add_false_to_index=False,
    kind: str = "float",
) -> Numbers:
    """true where a value is in a range; either value may be added to the flat index of the element."""
    cols = {}
    for j, c in enumerate(x.columns):
        flat = (F.col("_i") * x.block_length + j).cast("double")
        held = within(F.col(c).cast("float").cast("double"), low, high)
        yes = F.lit(float(true)) + (flat if add_true_to_index else F.lit(0.0))
        no = F.lit(float(false)) + (flat if add_false_to_index else F.lit(0.0))
        cols[c] = to_kind(F.when(~held if invert else held, yes).otherwise(no), kind)
    return x.with_columns(cols, kind)


def in_several_ranges(x: Numbers, thresholds: list[float], values: list[float]) -> Numbers:
    """Value behind the last threshold, in the order of the list, that an element reaches."""

    def f(c: Column) -> Column:
        out = F.lit(float(values[0]))
        for t, v in zip(thresholds, values[1:]):
            out = F.when(ieee(c >= F.lit(float(t)), c), F.lit(float(v))).otherwise(out)
        return out

    return x.map(f, "float")


def product_of_powers(x: Numbers, y: Numbers | None = None, a="1.0", b="1.0", m: float = 1.0) -> Numbers:
    """m x^a y^b."""
    pa, pb = power_text(a), power_text(b)

    def power(v: Column, p: float) -> Column:
        return v.cast("double") if p == 1 else F.pow(v.cast("double"), F.lit(p))

    return pairwise(x, y, lambda p, q: m * power(p, pa) * (power(q, pb) if q is not None else F.lit(1.0)), wide(x))


def sum_of_powers(inputs: list[Numbers | None], power="2.0", power_of_sum="1.0 / 2.0", divider: float = 1.0) -> Numbers:
    """((sum of a^p) / d)^q."""
    given = [n for n in inputs if n is not None]
    p, q = power_text(power), power_text(power_of_sum)
    df, names = zipped(*given)
    cols = []
    for k, c in enumerate(given[0].columns):
        total = sum((F.pow(F.col(own[k]).cast("double"), F.lit(p)) for own in names), F.lit(0.0))
        cols.append(F.pow(total / divider, F.lit(q)).cast("float").alias(c))
    return Numbers(df.select("_i", *cols), given[0].columns, "float")


def trigonometry(x: Numbers, function: str, degrees=False, multiplier: float = 1.0) -> Numbers:
    """sin, cos, tan of angles, or asin, acos, atan giving angles; as float."""
    inverse = function.startswith("a")

    def f(c: Column) -> Column:
        d = c.cast("double")
        d = F.radians(d) if degrees and not inverse else d
        out = getattr(F, function)(d)
        return (F.degrees(out) if degrees and inverse else out) * multiplier

    return x.map(f, "float")


TURN = 2 * math.pi
ANGLES = {
    "ZERO_2PI": lambda a: F.when(a < 0, a + TURN).otherwise(a),
    "ZERO_2PI_AS_0_1": lambda a: F.when(a < 0, a + TURN).otherwise(a) / TURN,
    "MINUS_PI_PLUS_PI": lambda a: a,
    "MINUS_PI_PLUS_PI_AS_MINUS_HALF_PLUS_HALF": lambda a: a / TURN,
    "MINUS_PI_PLUS_PI_AS_MINUS_1_PLUS_1": lambda a: a / math.pi,
    "MINUS_PI_PLUS_PI_AS_0_1": lambda a: a / TURN + 0.5,
}


def polar(
    x: Numbers, y: Numbers, angle_range: str = "MINUS_PI_PLUS_PI", multiplier=1.0, epsilon=-1.0, little_angle=0.0
) -> Numbers:
    """Columns r and fi of points."""
    df, (a, b) = zipped(x.cast("float"), y.cast("float")) if x.df is not y.df else zipped(x, y)
    p, q = F.col(a[0]).cast("float").cast("double"), F.col(b[0]).cast("float").cast("double")
    square = p * p + q * q
    angle = ANGLES[angle_range](F.atan2(q, p)) * multiplier
    angle = F.when(square <= epsilon, F.lit(float(little_angle))).otherwise(angle)
    return Numbers(
        df.select("_i", F.sqrt(square).cast("float").alias("r"), angle.cast("float").alias("fi")), ("r", "fi"), "float"
    )


def cartesian(r: Numbers, fi: Numbers, multiplier: str = "NONE", custom: float = 1.0) -> Numbers:
    """Columns x and y of polar points."""
    factor = {
        "NONE": 1.0,
        "MULTIPLIER_TO_RADIANS": math.pi / 180,
        "MULTIPLIER_PI": math.pi,
        "MULTIPLIER_2PI": TURN,
        "CUSTOM": custom,
    }[multiplier]
    df, (a, b) = zipped(r, fi)
    p, q = F.col(a[0]).cast("float").cast("double"), F.col(b[0]).cast("float").cast("double") * factor
    return Numbers(
        df.select("_i", (p * F.cos(q)).cast("float").alias("x"), (p * F.sin(q)).cast("float").alias("y")), ("x", "y"), "float"
    )


def all_equal(x: Numbers | None, y: Numbers | None) -> bool:
    """Whole-array equality: sizes and all elements; two missing arrays are equal."""
    if x is None or y is None:
        return x is y
    if x.block_length != y.block_length or x.kind != y.kind:
        return False
    a = x.df.select("_i", *[F.col(c).alias(f"a{k}") for k, c in enumerate(x.columns)])
    b = y.df.select("_i", *[F.col(c).alias(f"b{k}") for k, c in enumerate(y.columns)], F.lit(1).alias("in_b"))
    same = F.col("in_b").isNotNull()
    for k in range(x.block_length):
        same = same & F.col(f"a{k}").eqNullSafe(F.col(f"b{k}"))
    both = a.withColumn("in_a", F.lit(1)).join(b, "_i", "full")
    same = F.coalesce(same & F.col("in_a").isNotNull(), F.lit(False))
    return bool(both.agg(F.coalesce(F.bool_and(same), F.lit(True))).first()[0])


def check_equal(x: Numbers | None, y: Numbers | None, on_fail: str = "THROW_EXCEPTION") -> bool:
    """all_equal that raises on failure unless told to return."""
    found = all_equal(x, y)
    if not found and on_fail == "THROW_EXCEPTION":
        raise AssertionError("the number arrays are different")
    return found


def check_in_range(x: Numbers, low=None, high=None, invert=False, on_fail: str = "THROW_EXCEPTION") -> bool:
    """Whether every element is in (or, inverted, outside) a range; an empty array is."""
    ok = F.lit(True)
    for c in x.columns:
        held = within(F.col(c).cast("double"), low, high)
        ok = ok & (~held if invert else held)
    found = bool(x.df.agg(F.coalesce(F.bool_and(ok), F.lit(True))).first()[0])
    if not found and on_fail == "THROW_EXCEPTION":
        raise AssertionError("numbers are out of range")
    return found


def scaled_columns(
    x: Numbers, weights: list[float] | dict | None, names: list[str], drop_zero=False, drop_absent=False, drop_nan=False
) -> Numbers:
    """Columns times weights, by position or by name; columns may be dropped by weight, absence or NaN."""
    by_name = isinstance(weights, dict)
    cols = {}
    full = set()
    if drop_nan:
        row = x.df.agg(*[F.coalesce(F.bool_and(F.isnan(F.col(c).cast("double"))), F.lit(False)).alias(c) for c in x.columns])
        full = {c for c, v in row.first().asDict().items() if v}
    for k, (c, name) in enumerate(zip(x.columns, names)):
        if by_name and name not in weights and drop_absent:
            continue
        w = float((weights.get(name, 1.0)) if by_name else weights[k] if weights and k < len(weights) else 1.0)
        if c in full or drop_zero and w == 0:
            continue
        cols[name] = to_kind(F.col(c).cast("double") * w, x.kind)
    if not cols:
        raise ValueError("no column is left")
    return x.with_columns(cols)

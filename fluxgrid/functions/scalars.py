"""Scalar operators as column functions: scalars are text columns, null is a port without a value."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxgrid.operators.arithmetic import power_text


def number(c: Column) -> Column:
    """Text as double; null if it is none."""
    return c.cast("string").try_cast("double")


def number_text(c: Column) -> Column:
    """A double as text, whole numbers without a fraction."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def truth(c: Column, style: str = "COMMON") -> Column:
    """Text as boolean: JAVA_LIKE only "true"; C_LIKE anything but "" and zero; COMMON also not "false"."""
    text = c.cast("string")
    if style == "JAVA_LIKE":
        return F.lower(text) == "true"
    value = text.try_cast("double")
    c_like = F.when(text == "", False).when(value.isNotNull(), value != 0).otherwise(True)
    return c_like if style == "C_LIKE" else F.when(F.lower(text) == "false", False).otherwise(c_like)


def styled(b: Column, style: str = "JAVA_LIKE") -> Column:
    """Boolean as text: true/false or 1/0."""
    yes, no = ("true", "false") if style == "JAVA_LIKE" else ("1", "0")
    return F.when(b, yes).when(~b, no)


def and_all(inputs: list[Column], invert=False, style="JAVA_LIKE", common=True) -> Column:
    """AND of inputs; missing ones are true."""
    out = F.lit(True)
    for c in inputs:
        out = out & F.coalesce(truth(c, "COMMON" if common else "JAVA_LIKE"), F.lit(True))
    return styled(~out if invert else out, style)


def or_all(inputs: list[Column], invert=False, style="JAVA_LIKE", common=True) -> Column:
    """OR of inputs; missing ones are false."""
    out = F.lit(False)
    for c in inputs:
        out = out | F.coalesce(truth(c, "COMMON" if common else "JAVA_LIKE"), F.lit(False))
    return styled(~out if invert else out, style)


def logical(x: Column, y: Column | None, kind: str, style="JAVA_LIKE", common=True, default=False) -> Column:
    """COPY, NOT, XOR, EQUIVALENCE, AND_NOT, OR_NOT of booleans; missing inputs take the default."""
    value = lambda c: F.coalesce(truth(c, "COMMON" if common else "JAVA_LIKE"), F.lit(default))
    a = value(x)
    b = value(y) if y is not None else None
    rules = {
        "COPY": lambda: a,
        "NOT": lambda: ~a,
        "XOR": lambda: a != b,
        "EQUIVALENCE": lambda: a == b,
        "AND_NOT": lambda: a & ~b,
        "OR_NOT": lambda: a | ~b,
    }
    return styled(rules[kind](), style)


def absolute(x: Column) -> tuple[Column, Column]:
    """|x| and whether x is negative."""
    return F.abs(number(x)), number(x) < 0


def rounded(x: Column, mode: str = "EVEN_ROUND_TO_LONG") -> Column:
    """One of eleven rounding modes; whole-number modes saturate."""
    if mode in {"SKIP_OPERATION", "NONE"}:
        return x
    from fluxgrid.model import to_kind

    value = number(x)
    steps = {
        "FLOOR_TO_DOUBLE": lambda: F.floor(value).cast("double"),
        "CEIL_TO_DOUBLE": lambda: F.ceil(value).cast("double"),
        "EVEN_ROUND_TO_DOUBLE": lambda: F.rint(value),
        "CAST_TO_LONG": lambda: to_kind(value, "long"),
        "CAST_TO_INT": lambda: to_kind(value, "int"),
        "ROUND_TO_LONG": lambda: to_kind(F.floor(value + 0.5).cast("double"), "long"),
        "ROUND_TO_INT": lambda: to_kind(F.floor(value + 0.5).cast("double"), "int"),
        "EVEN_ROUND_TO_LONG": lambda: to_kind(F.rint(value), "long"),
        "EVEN_ROUND_TO_INT": lambda: to_kind(F.rint(value), "int"),
    }
    return steps[mode]()


def linear(x: Column, y: Column | None = None, a=1.0, b=1.0, summand=0.0, absolute_value=False, mode="NONE") -> Column:
    """a x + b y + summand, rounded by a mode."""
    out = number(x) * a + summand
    out = out if y is None else out + F.coalesce(number(y) * b, F.lit(0.0))
    return rounded(F.abs(out) if absolute_value else out, mode) if mode != "NONE" else (F.abs(out) if absolute_value else out)


def product_of_powers(x: Column, y: Column | None = None, a="1.0", b="1.0", m=1.0) -> Column:
    """m x^a y^b."""
    out = F.pow(number(x), F.lit(power_text(a))) * m
    return out if y is None else out * F.pow(number(y), F.lit(power_text(b)))


def compare(x: Column, y: Column, default_x=0.0, default_y=0.0, style="JAVA_LIKE") -> dict[str, Column]:
    """Six comparisons of two numbers."""
    a, b = F.coalesce(number(x), F.lit(default_x)), F.coalesce(number(y), F.lit(default_y))
    tests = {"equal": a == b, "less": a < b, "less_or_equal": a <= b, "greater": a > b, "greater_or_equal": a >= b}
    real = ~F.isnan(a) & ~F.isnan(b)  # a comparison with NaN is false, so it is not equal to anything
    tests = {k: v & real for k, v in tests.items()}
    tests["non_equal"] = ~tests["equal"]
    return {k: styled(v, style) for k, v in tests.items()}


def same(x: Column, y: Column, numeric=False, unequal=False, style="JAVA_LIKE") -> Column:
    """Equality of texts (null-safe) or numbers."""
    test = number(x).eqNullSafe(number(y)) if numeric else x.eqNullSafe(y)
    return styled(~test if unequal else test, style)


def in_range(x: Column, low=None, high=None, invert=False, style="JAVA_LIKE") -> Column:
    """low <= x <= high."""
    value = number(x)
    out = value.isNotNull() & ~F.isnan(value) if low is not None or high is not None else F.lit(True)
    out = F.when(value.isNotNull(), out)
    if low is not None:
        out = out & (value >= low)
    if high is not None:
        out = out & (value <= high)
    return styled(~out if invert else out, style)


def truncated(x: Column, low=None, high=None) -> tuple[Column, Column]:
    """x clamped to a range, and whether that changed it."""
    value = number(x)
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return out, out != value


def extreme(inputs: list[Column], largest: bool, threshold: float | None = None) -> Column:
    """Largest or smallest of the given numbers and a threshold; NaN if one of them is."""
    from fluxgrid.model import extreme_of

    given = [number(c) for c in inputs] + ([F.lit(float(threshold))] if threshold is not None else [])
    return extreme_of(given, largest)


def range_to_constant(x: Column, low=None, high=0.0, replacement="") -> Column:
    """Numbers in a range replaced; other texts stay."""
    value = number(x)
    held = value.isNotNull()
    if low is not None:
        held = held & (value >= low)
    if high is not None:
        held = held & (value <= high)
    return F.when(held, F.lit(replacement)).otherwise(x)


def length(x: Column, trim=False) -> Column:
    """Characters of a text."""
    return F.length(F.trim(x) if trim else x)


def concatenated(inputs: list[Column], separator: str = ", ", pattern: str = "", defaults: list[str] | None = None) -> Column:
    """Texts joined by a separator, or put in the places {1}, {2}... of a pattern."""
    defaults = defaults or [""] * len(inputs)
    given = [F.coalesce(c, F.lit(d) if d else F.lit(None).cast("string")) for c, d in zip(inputs, defaults)]
    if not pattern:
        return F.concat_ws(separator, *given)
    out = F.lit(pattern)
    for k, c in enumerate(given, 1):
        out = F.replace(out, F.lit("{%d}" % k), F.coalesce(c, F.lit("")))
    return out


def inserted(x: Column, pattern: str = "$$$", what: str = "$$$") -> Column:
    """The pattern with x in place of a mark."""
    return F.replace(F.lit(pattern), F.lit(what), x)


def split(x: Column, separator: str = r"[\s,;]+", k: int = 0, default: str = "") -> Column:
    """Part k of a text; the default where there is none."""
    part = F.get(F.split(x, separator), F.lit(k))
    return F.coalesce(part, F.lit(default)) if default else part


def numbers(x: Column) -> Column:
    """Array of the numbers of a text."""
    return F.transform(
        F.filter(F.split(x, r"[,;\s]+"), lambda v: v != ""), lambda v: v.try_cast("double")
    )


def joined_numbers(values: Column, delimiter: str = ", ", pattern: str | None = None) -> Column:
    """An array of numbers as text, each by a printf pattern if given."""
    one = (lambda v: F.format_string(pattern, v)) if pattern else number_text
    return F.array_join(F.transform(values, one), delimiter)


def json_keys(x: Column) -> Column:
    """Top-level keys, one a line."""
    return F.array_join(F.json_object_keys(x), "\n")


def json_value(x: Column, key: str, default: str | None = "") -> Column:
    """Top-level value as text."""
    found = F.get_json_object(x, f"$['{key}']")
    return found if default is None else F.coalesce(found, F.lit(default))


def json_with(x: Column, key: str, value: Column, kind: str = "STRING") -> Column:
    """A JSON object with one key set to a value of a kind; other values keep their types, a present key its place."""
    text = F.trim(value.cast("string"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    new = {
        "STRING": lambda: quoted(text),
        "DOUBLE": lambda: quoted(text.cast("double")),
        "INTEGER": lambda: text.cast("bigint").cast("string"),
        "BOOLEAN": lambda: F.when(F.lower(text) == "true", "true").otherwise("false"),
        "JSON_OBJECT": lambda: text,
        "JSON_ARRAY": lambda: text,
        "NULL": lambda: F.lit("null"),
    }[kind]()
    name = F.lit(json.dumps(key))
    # every value as JSON text: an object of one key, without its frame
    keys = F.json_object_keys(x)
    values = F.from_json(x, "map<string,variant>")
    raw = lambda k: F.coalesce(F.to_json(values[k]), F.lit("null"))
    entry = lambda k: F.concat(quoted(k), F.lit(":"), F.when(k == key, new).otherwise(raw(k)))
    old = F.array_join(F.transform(keys, entry), ",")
    added = F.concat(name, F.lit(":"), new)
    body = F.when(F.array_contains(keys, key), old).when(F.size(keys) == 0, added).otherwise(F.concat(old, F.lit(","), added))
    return F.concat(F.lit("{"), body, F.lit("}"))


def list_lines(x: Column, comments: bool = True) -> Column:
    """Lines of a multi-line text without blank ones and, on demand, without // comments."""
    lines = F.transform(F.split(x, r"\r?\n"), lambda v: F.trim(F.regexp_replace(v, r"//.*$", "") if comments else v))
    return F.filter(lines, lambda v: v != "")


def rows_if(condition: Column, invert=False, style="JAVA_LIKE") -> Column:
    """Row form of cancelling: rows that go on."""
    held = F.coalesce(truth(condition, style), F.lit(False))
    return held if invert else ~held


def chosen(condition: Column, when_true: Column, when_false: Column, style="JAVA_LIKE", default=False) -> Column:
    """Row form of if: one of two columns."""
    return F.when(F.coalesce(truth(condition, style), F.lit(default)), when_true).otherwise(when_false)


def switched(selector: Column, inputs: list[Column]) -> Column:
    """Row form of switch: input number 1.. by selector, 0 takes the first that has a value."""
    out = F.coalesce(*inputs)
    for k, c in enumerate(inputs, 1):
        out = F.when(selector == k, c).otherwise(out)
    return F.when(selector.between(0, len(inputs)), out)

"""Formula operators: an arithmetic subset of formula texts, translated to column expressions."""

from __future__ import annotations

import ast
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxgrid.model import Numbers, beside, to_kind

BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Pow: lambda a, b: F.pow(a, b),
    ast.Div: lambda a, b: F.try_divide(a, b), ast.Mod: lambda a, b: a % b,
}
COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
CALLS = {
    "sqrt": F.sqrt, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "atan": F.atan, "atan2": F.atan2, "exp": F.exp,
    "log": F.ln, "pow": F.pow, "floor": F.floor, "ceil": F.ceil, "min": F.least, "max": F.greatest, "hypot": F.hypot,
    "round": lambda c: F.floor(c + 0.5),
}
CONSTANTS = {"PI": math.pi, "E": math.e}


def prepared(text: str) -> str:
    """Operators of the formula language in those of the parser: a ? b : c, &&, ||, !, ===."""
    text = text.replace("Math.", "").replace("===", "==").replace("!==", "!=").replace("&&", " and ").replace("||", " or ")
    if "?" in text:
        test, _, rest = text.partition("?")
        yes, _, no = rest.partition(":")
        text = f"({yes.strip()}) if ({test.strip()}) else ({prepared(no).strip()})"
    return text


def compiled(text: str, names: dict[str, Column | list[Column]]) -> Column:
    """A formula as a column expression; anything beyond arithmetic is refused."""

    def build(node) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id in names:
                return names[node.id]
            if node.id in CONSTANTS:
                return F.lit(CONSTANTS[node.id])
        if isinstance(node, ast.Attribute) and node.attr in CONSTANTS:
            return F.lit(CONSTANTS[node.attr])
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and isinstance(node.slice, ast.Constant):
            return names[node.value.id][node.slice.value]
        if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
            return BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in COMPARE:
            return COMPARE[type(node.ops[0])](build(node.left), build(node.comparators[0]))
        if isinstance(node, ast.BoolOp):
            join = operator.and_ if isinstance(node.op, ast.And) else operator.or_
            out = build(node.values[0])
            for v in node.values[1:]:
                out = join(out, build(v))
            return out
        if isinstance(node, ast.IfExp):
            return F.when(build(node.test), build(node.body)).otherwise(build(node.orelse))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in CALLS:
            return CALLS[node.func.id](*[build(a) for a in node.args])
        raise ValueError(f"the formula goes beyond arithmetic: {text}")

    return build(ast.parse(prepared(text).strip(), mode="eval"))


def elementwise(formula: str, inputs: dict[str, Numbers], kind: str = "float", **parameters: float) -> Numbers:
    """One formula over equally named elements of several arrays."""
    both, names = beside(*inputs.values())
    first = next(iter(inputs.values()))
    constants = {k: F.lit(float(v)) for k, v in parameters.items()}
    cols = []
    for j, c in enumerate(first.columns):
        bound = {n: F.col(own[j]).cast("double") for n, own in zip(inputs, names)}
        cols.append(to_kind(compiled(formula, {**constants, **bound}), kind))
    return both.with_columns(dict(zip(first.columns, cols)), kind)


def by_row(formula: str, inputs: dict[str, Numbers], kind: str = "float", **parameters: float) -> Numbers:
    """One formula over the rows of several arrays: a[0], b[1] and the row's number i."""
    both, names = beside(*inputs.values())
    bound: dict = {k: F.lit(float(v)) for k, v in parameters.items()}
    bound |= {n: [F.col(c).cast("double") for c in own] for n, own in zip(inputs, names)}
    bound["i"] = F.col("_i").cast("double")
    return both.with_columns({"c0": to_kind(compiled(formula, bound), kind)}, kind)

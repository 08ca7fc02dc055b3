"""Script operators: scripts over rows and scalars, and Python functions over arrays."""

from __future__ import annotations

import importlib
import importlib.util
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxgrid.model import Numbers, beside, to_kind
from fluxgrid.plans.javascript import Script

def as_numbers(values: list) -> list[Column]:
    """Results of a script as columns."""
    return [v if isinstance(v, Column) else F.lit(None if v is None else float(v)).cast("double") for v in values]


def modify_named(x: Numbers, names: list[str], text: str = "x0 = x1 * p", **parameters: float) -> Numbers:
    """A script over the columns of every row by name (or x0, x1...); i is the row's number."""
    bound: dict = {k: float(v) for k, v in parameters.items()}
    bound["i"] = F.col("_i").cast("double")
    aliases = [[f"x{k}", *names[k : k + 1]] for k in range(x.block_length)]
    start = {n: F.col(c).cast("double") for own, c in zip(aliases, x.columns) for n in own}
    script = Script(text, {**bound, **start})
    # both names of a column are one variable: the script sees it under its first name
    other = {own[-1]: own[0] for own in aliases}
    script.body = renamed(script.body, other)
    script.run()
    return x.with_columns({c: to_kind(v, x.kind) for c, v in zip(x.columns, as_numbers([script.names[own[0]] for own in aliases]))})


def renamed(node, names: dict[str, str]):
    """A parsed script with other names of variables."""
    if isinstance(node, tuple) and node[:1] == ("name",):
        return ("name", names.get(node[1], node[1]))
    if isinstance(node, (tuple, list)):
        return type(node)(renamed(x, names) for x in node)
    return node


def modify_several(inputs: dict[str, Numbers], text: str = "a[0] = a[0] * p + k", **parameters: float) -> dict[str, Numbers]:
    """A script over the elements of the rows of several arrays; i and k are the row's number."""
    both, names = beside(*inputs.values())
    place = F.col("_i").cast("double")
    bound: dict = {**{k: float(v) for k, v in parameters.items()}, "i": place, "k": place}
    script = Script(text, {**bound, **{n: [F.col(c).cast("double") for c in own] for n, own in zip(inputs, names)}})
    script.run()
    out = {}
    for n, x in inputs.items():
        found = as_numbers(script.names[n])
        out[n] = both.with_columns({c: to_kind(v, x.kind) for c, v in zip(x.columns, found)}, x.kind)
    return out


def scalar_formula(spark, formula: str = "a + b", functions: str = "", **values: str | float):
    """The value of a script of scalars on the driver; numeric texts are numbers."""
    names = {k: (float(v) if re.fullmatch(r"\s*[-+]?[0-9.]+(?:[eE][-+]?\d+)?\s*", str(v)) else v) for k, v in values.items()}
    script = Script(f"{functions}\n{formula}", names)
    return script.run()


def use(text: str, parameters: dict | None = None, inputs: dict | None = None, function: str = "execute") -> dict:
    """A script on the driver: function(params, inputs, outputs) if there is one; outputs by name."""
    outputs: dict = {}
    script = Script(text, {"params": dict(parameters or {}), "inputs": dict(inputs or {}), "outputs": outputs})
    found = script.run()
    if function in script.names:
        found = script.names[function](script.names["params"], script.names["inputs"], outputs)
    outputs.setdefault("output", found)
    return outputs


def repeat(start: dict[str, float], step: str, condition: str, most: int | None = None) -> dict[str, float]:
    """Do-while over scalars on the driver: a script, then a condition; i is the number of rounds."""
    now, count = {k: float(v) for k, v in start.items()}, 0
    while True:
        script = Script(step, {**now, "i": float(count)})
        script.run()
        now = {k: v for k, v in script.names.items() if k != "i"}
        count += 1
        go_on = Script(condition, {**now, "i": float(count)})
        if not go_on.truth(go_on.run()) or (most is not None and count >= most):
            return {**now, "i": count}


def function_of(module: str, name: str = "execute") -> Callable:
    """A function of a module or of a Python file."""
    if module.endswith(".py"):
        spec = importlib.util.spec_from_file_location("fluxgrid_script", module)
        loaded = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(loaded)
    else:
        loaded = importlib.import_module(module)
    return getattr(loaded, name)


def call_by_batches(x: Numbers, function: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], kind: str = "double") -> Numbers:
    """A Python function over Arrow batches of rows; rows keep their positions, as many come back as go in."""
    names = list(x.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = function(f[names])
            out = pd.DataFrame({c: found[c].to_numpy("float64") for c in columns})
            out.insert(0, "_i", f["_i"].to_numpy())
            yield out

    df = x.df.mapInPandas(run, "_i long, " + ", ".join(f"{c} double" for c in columns))
    return Numbers(df, tuple(columns), "double").cast(kind)


def call(function: Callable[[dict, dict, dict], object], parameters: dict, inputs: dict) -> dict:
    """execute(params, inputs, outputs): what it puts in outputs, and its result as ``output`` unless set."""
    outputs: dict = {}
    result = function(parameters, inputs, outputs)
    outputs.setdefault("output", result)
    return outputs

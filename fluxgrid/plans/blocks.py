"""Chain blocks of every registered operator: ports and parameters of a block bound to a function's arguments."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fluxgrid import registry
from fluxgrid.operators.constants import number_text
from fluxgrid.plans import scripts

#: Parameters of block files under the names that functions have.
ALIASES = {
    "element_type": "kind", "raw_cast": "raw", "raw_values": "raw", "min": "low", "max": "high", "rounding_mode": "mode",
    "indexing_base": "base", "number_of_channels": "n", "block_index": "row", "index_in_block": "column", "resizing_mode": "mode",
    "source_color": "fill", "color": "fill", "block_length": "width", "boolean_style": "style", "condition_style": "style",
}
#: Functions that several operators share, with what tells them apart.
FIXED = {
    "MaxNumbers": {"largest": True}, "MinNumbers": {"largest": False}, "MaxMatrix": {"largest": True}, "MinMatrix": {"largest": False},
    "MaxNumber": {"largest": True}, "MinNumber": {"largest": False}, "RawCastPrecision": {"raw": True},
    **{f"{k}Boolean": {"kind": v} for k, v in {"AndNot": "AND_NOT", "Copy": "COPY", "Equivalence": "EQUIVALENCE", "Not": "NOT", "OrNot": "OR_NOT", "Xor": "XOR"}.items()},
}


def snake(name: str) -> str:
    """camelCase as snake_case."""
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def scalar_value(column_value):
    """A result of a scalar function as a driver scalar."""
    if isinstance(column_value, bool):
        return str(column_value).lower()
    return number_text(column_value) if isinstance(column_value, float) else column_value


def evaluated(found) -> dict:
    """Column results in one row of driver scalars."""
    cols = found if isinstance(found, dict) else dict(enumerate(found)) if isinstance(found, (tuple, list)) else {0: found}
    row = SparkSession.getActiveSession().range(1).select(*[c.alias(str(k)) for k, c in cols.items()]).first()
    values = {k: scalar_value(row[str(k)]) for k in cols}
    return values if isinstance(found, dict) else numbered_outputs(list(values.values()))


def numbered_outputs(values: list) -> dict:
    """The first as ``output``, and all as output_1, output_2..."""
    return {"output": values[0] if values else None, **{f"output_{k}": v for k, v in enumerate(values, 1)}}


def results(found) -> dict:
    """Outputs by name of what a function returns."""
    first = found[0] if isinstance(found, (tuple, list)) and found else next(iter(found.values()), None) if isinstance(found, dict) else found
    if isinstance(first, Column):
        return evaluated(found)
    if isinstance(found, dict):
        return found
    return numbered_outputs(list(found)) if isinstance(found, (tuple, list)) else {"output": found}


def bound_arguments(name: str, function: Callable, values: dict, ports: dict) -> dict:
    """Arguments of a function from a block's parameters and the values at its ports."""
    params = [p for p in inspect.signature(function).parameters.values() if p.kind != p.VAR_KEYWORD]
    names = {p.name for p in params}
    out = dict(FIXED.get(name, {}))
    several: dict[str, list] = {}
    for raw, v in values.items():
        key = snake(raw)
        if (m := re.fullmatch(r"(.+)_(\d+)", key)) and m[1] in names:  # a_1, a_2... are one list
            several.setdefault(m[1], []).append((int(m[2]), v))
            continue
        key = key if key in names else ALIASES.get(key, key)
        if key in names and key not in out and v is not None and v != "unchanged":
            out[key] = v
    left = []
    for port, v in ports.items():
        key = snake(port)
        if key in names and key not in out:
            out[key] = v
        else:
            left.append(v)
    open_params = [p for p in params if p.name not in out and p.name not in several and p.name != "spark"]
    for p in open_params:
        kind = str(p.annotation)
        if not left:
            break
        if kind.startswith(("list[", "tuple[")):
            out[p.name], left = left, []
        elif p.default is p.empty or kind.split(" ")[0] in {"Numbers", "Matrix", "Column"}:
            out[p.name] = left.pop(0)
    size = max([len(v) for v in out.values() if isinstance(v, list)], default=None)
    out |= {k: [v for _, v in sorted(pairs)][:size] for k, pairs in several.items()}
    if "spark" in names:
        out["spark"] = SparkSession.getActiveSession()
    # scalar functions are column expressions
    for p in params:
        if str(p.annotation).startswith("Column") and p.name in out:
            out[p.name] = F.lit(str(out[p.name]))
        elif str(p.annotation).startswith("list[Column") and p.name in out:
            out[p.name] = [F.lit(str(v)) for v in out[p.name]]
    return out


def block(name: str) -> Callable[[dict, dict], dict]:
    """The function of an operator as a chain block."""
    function = registry.find(name)

    def run(values: dict, inputs) -> dict:
        ports = {k: v for k in inputs if (v := inputs[k]) is not None}
        return results(function(**bound_arguments(name, function, values, ports)))

    return run


class Named(dict):
    """Values by name, as items or as attributes."""

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return self.get(name)

    def __setattr__(self, name: str, value) -> None:
        self[name] = value


def script_block(spec: dict, modules: Path) -> Callable | None:
    """A block whose function is in a script module: execute(params, inputs, outputs) in its language."""
    language = spec.get("language")
    if language not in {"js", "python"} or language not in spec:
        return None
    name, function = spec[language].get("module", ""), spec[language].get("function") or "execute"
    defaults = {c["name"]: c.get("default") for c in spec.get("controls", [])}

    def run(values: dict, inputs) -> dict:
        params = {**defaults, **values}
        given = {k: inputs[k] for k in inputs}
        if language == "js":
            text = (modules / name).read_text(encoding="utf-8")
            text = re.sub(r"(?m)^\s*import\b.*$|^\s*export\s+(?:default\s+)?", "", text)
            return scripts.use(text, params, given, function)
        path = modules / (name.replace(".", "/") + ".py")
        loaded = scripts.function_of(str(path) if path.exists() else name, function)
        outputs = Named()
        result = loaded(Named(params), Named(given), outputs)
        outputs.setdefault("output", result)
        return dict(outputs)

    return run


def specified(folder: str, modules: str = ".") -> dict[str, Callable]:
    """Blocks by id and name of the executor specifications (JSON files) of a folder.

    A specification names a class, of which the registry has the operator, or a script module below ``modules``.
    """
    out = {}
    for path in sorted(Path(folder).rglob("*.json")):
        spec = json.loads(path.read_text(encoding="utf-8"))
        if not isinstance(spec, dict):
            continue
        owner = (spec.get("java") or {}).get("class", "").rpartition(".")[2]
        found = block(owner) if owner in registry.OPERATORS else script_block(spec, Path(modules))
        for key in filter(None, (spec.get("id"), spec.get("name"))):
            if found:
                out.setdefault(key, found)
    return out

"""Constants, JSON copies, printed values and conditional copies on the driver."""

from __future__ import annotations

import json
import logging

from fluxgrid.operators.flow import truth

LOG = logging.getLogger("fluxgrid")
#: Characters of a printed value.
MAX_PRINTED = 50_000


def number_text(v: float) -> str:
    """A double as text, whole numbers without a fraction."""
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(float(v))


def create_boolean(value: bool = False, given: str | None = None, style: str = "JAVA_LIKE") -> str:
    """true/false or 1/0; a given value wins."""
    if given is not None:
        return given
    return ("true" if value else "false") if style == "JAVA_LIKE" else ("1" if value else "0")


def create_double(value: float = 0.0, given: str | None = None) -> str:
    """A double as text; a given value wins."""
    return number_text(value) if given is None else given


def create_integer(value: int = 0, given: str | None = None) -> str:
    """A whole number as text; a given value wins."""
    return str(int(value)) if given is None else given


def create_scalar(value: str = "New scalar", given: str | None = None) -> str:
    """A text; a given value wins."""
    return value if given is None else given


def copy_json(text: str | None, pretty: bool = True, required: bool = True) -> str | None:
    """A JSON text that parses, on demand printed with indents."""
    if text is None:
        if required:
            raise ValueError("no input")
        return None
    found = json.loads(text)
    return json.dumps(found, indent=2) if pretty else text


def create_json(value: str = "{}", given: str | None = None) -> str:
    """A JSON constant; a given value wins."""
    return copy_json(value if given is None else given, False)


def print_scalar(value: str | None, pattern: str = "$$$", level: str = "PRINTLN_TO_CONSOLE", file: str = "", act: bool = True) -> str | None:
    """The value put in a pattern, logged or written; the value goes on."""
    if act:
        text = pattern.replace("$$$", str(value))
        if len(text) > MAX_PRINTED:
            text = text[:MAX_PRINTED] + "..."
        if file:
            write_scalar(text, file)
        elif level.startswith("PRINT"):
            print(text, end="\n" if level == "PRINTLN_TO_CONSOLE" else "")
        else:
            LOG.log({"TRACE": 5, "DEBUG": 10, "INFO": 20}.get(level, 20), text)
    return value


def write_scalar(value: str | None, file: str, content: str = "", charset: str = "UTF-8", delete_if_empty: bool = False) -> str:
    """A text in a file; empty texts may delete it."""
    import os

    text = content if value is None else value
    if not text and delete_if_empty:
        if os.path.exists(file):
            os.remove(file)
        return file
    with open(file, "w", encoding=charset) as f:
        f.write(text)
    return file


def copy_if_requested(values: dict, conditions: dict[str, str | None], style: str = "JAVA_LIKE") -> dict:
    """The values whose own condition holds."""
    return {k: v for k, v in values.items() if truth(conditions.get(k), style)}


def print_sub_matrix(m, start: tuple[int, int] = (0, 0), size: tuple[int, int] = (10, 10), delimiter: str = " ", pattern: str = "%s") -> str:
    """Text of a box of a matrix, channel by channel; the box bounds what reaches the driver."""
    from pyspark.sql import functions as F

    box = F.col("x").between(start[0], start[0] + size[0] - 1) & F.col("y").between(start[1], start[1] + size[1] - 1)
    cells = {(r.x, r.y): r for r in m.df.where(box).limit(size[0] * size[1]).collect()}
    blocks = []
    for c in m.names:
        lines = []
        for y in range(start[1], min(start[1] + size[1], m.dims[1])):
            xs = range(start[0], min(start[0] + size[0], m.dims[0]))
            lines.append(delimiter.join(pattern % cells[x, y][c] for x in xs))
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks)

"""Flow operators on the driver: conditions, switches, redirection and loops decide which plans are built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

#: Exceptions that a chain may raise by name.
EXCEPTIONS = {
    "NULL_POINTER_EXCEPTION": ValueError,
    "ILLEGAL_ARGUMENT_EXCEPTION": ValueError,
    "ILLEGAL_STATE_EXCEPTION": RuntimeError,
    "INDEX_OUT_OF_BOUNDS_EXCEPTION": IndexError,
    "UNSUPPORTED_OPERATION_EXCEPTION": NotImplementedError,
    "ASSERTION_ERROR": AssertionError,
}


def truth(text: str | None, style: str = "JAVA_LIKE", default: bool = False) -> bool:
    """Text as boolean on the driver."""
    if text is None:
        return default
    if style == "JAVA_LIKE":
        return text.lower() == "true"
    if style == "COMMON" and text.lower() == "false":
        return False
    if text == "":
        return False
    try:
        return float(text) != 0
    except ValueError:
        return True


def value_of(x):
    """A port's value; a function is called, so a branch that nobody asks for is never built."""
    return x() if callable(x) else x


def choose(condition: str | None, when_true, when_false, style="JAVA_LIKE", default=False, required=False):
    """One of two values by condition; only the chosen one is asked for."""
    out = value_of(when_true if truth(condition, style, default) else when_false)
    if out is None and required:
        raise ValueError("the chosen input has no value")
    return out


def switch(selector: int, inputs: list, required=False):
    """Input 1.. by selector; 0 takes the first that has a value."""
    if selector == 0:
        for x in inputs:
            if (out := value_of(x)) is not None:
                return out
        out = None
    elif not 0 < selector <= len(inputs):
        raise ValueError(f"no input {selector}")
    else:
        out = value_of(inputs[selector - 1])
    if out is None and required:
        raise ValueError("the chosen input has no value")
    return out


def redirect(x, redirector: int, n: int = 9) -> list:
    """The input at output ``redirector`` (1..n), nothing at the others."""
    return [x if k == redirector else None for k in range(1, n + 1)]


def exists(x, when_missing="false", when_given="true", non_empty=False) -> str:
    """Text by whether a port has a value (and, on demand, rows or characters)."""
    if x is None:
        return when_missing
    if non_empty:
        empty = x == "" if isinstance(x, str) else (x.df if hasattr(x, "df") else x).isEmpty()
        return when_missing if empty else when_given
    return when_given


class Cancelled(Exception):
    """Raised to skip what depends on a cancelled port."""


def cancel_or_copy(condition: str | None, values: dict, style="JAVA_LIKE", invert=False) -> dict:
    """The values, or nothing when the condition holds."""
    held = truth(condition, style) != invert
    return {} if held else dict(values)


def throw_if(condition: str | None, kind="ILLEGAL_ARGUMENT_EXCEPTION", message="Something goes wrong", style="JAVA_LIKE", invert=False):
    """Raise when the condition holds."""
    if truth(condition, style) != invert:
        raise EXCEPTIONS[kind](message)


@dataclass
class Loop:
    """State of a do-while loop over a chain."""

    condition_style: str = "JAVA_LIKE"
    invert: bool = False
    most: int | None = None
    count: int = field(default=0)

    def run(self, body: Callable[[int], str | None]) -> int:
        """Repeat while ``body`` returns a condition that holds (missing: true); the number of rounds."""
        if self.most is None and not callable(body):
            raise ValueError("an endless loop")
        while True:
            condition = body(self.count)
            self.count += 1
            go_on = truth(condition, self.condition_style, True) != self.invert
            if not go_on or (self.most is not None and self.count >= self.most):
                return self.count

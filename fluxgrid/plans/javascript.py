"""Scripts of block operators: a subset of JavaScript, run over driver values or compiled to column expressions.

Values are numbers, texts, booleans, null, arrays, objects, functions and Spark columns.  A script over driver
values runs as it is written.  Over columns it is executed symbolically: arithmetic builds expressions, both sides
of a condition on columns are followed and their results joined by ``CASE WHEN``, and loops whose bounds are driver
values are unrolled, so a row operator stays a projection without user functions.  A loop on a column's value is
refused.  Variables belong to their function; there are no classes, exceptions to catch or modules.
"""

from __future__ import annotations

import logging
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG = logging.getLogger("fluxgrid")
TOKEN = re.compile(
    r"(?P<space>[ \t\r\n]+|//[^\n]*|/\*.*?\*/)|(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|(?P<name>[A-Za-z_$][\w$]*)"
    r"|(?P<text>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<mark>===|!==|\*\*=|=>|==|!=|<=|>=|&&|\|\||\+\+|--|\*\*|[-+*/%]=|[-+*/%<>=!?:;,.(){}\[\]])",
    re.S,
)
WORDS = {"var", "let", "const", "function", "if", "else", "while", "do", "for", "return", "break", "continue", "throw", "true", "false", "null", "undefined", "typeof", "new"}
#: Binding power of binary operators.
POWER = {"||": 1, "&&": 2, "==": 3, "!=": 3, "===": 3, "!==": 3, "<": 4, ">": 4, "<=": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "**": 8}
#: Steps after which a script on the driver is taken for endless.
MOST_STEPS = 2_000_000


def tokens(text: str) -> list[tuple[str, str, bool]]:
    """(kind, text, whether a line begins before it) of every token."""
    out, at, line = [], 0, False
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at : at + 10]!r} in a script")
        if m.lastgroup == "space":
            line |= "\n" in m[0]
        else:
            kind = "word" if m.lastgroup == "name" and m[0] in WORDS else m.lastgroup
            out.append((kind, m[0], line))
            line = False
        at = m.end()
    return [*out, ("end", "", True)]


class Parser:
    """Statements and expressions as nested tuples."""

    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self, *marks: str) -> bool:
        kind, text, _ = self.tokens[self.at]
        return kind in {"mark", "word"} and text in marks

    def take(self, *marks: str) -> str | None:
        if self.peek(*marks):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise ValueError(f"{mark!r} expected before {self.tokens[self.at][1]!r} in a script")

    def name(self) -> str:
        kind, text, _ = self.tokens[self.at]
        if kind != "name":
            raise ValueError(f"a name expected before {text!r} in a script")
        self.at += 1
        return text

    def end(self) -> None:
        """End of a simple statement: a semicolon, a new line, or the end of a block."""
        kind, text, line = self.tokens[self.at]
        if not self.take(";") and not (line or kind == "end" or text == "}"):
            raise ValueError(f"unexpected {text!r} in a script")

    def program(self) -> list:
        out = []
        while self.tokens[self.at][0] != "end":
            out.append(self.statement())
        return out

    def block(self) -> list:
        if not self.take("{"):
            return [self.statement()]
        out = []
        while not self.take("}"):
            out.append(self.statement())
        return out

    def statement(self):
        if self.peek("{"):
            return ("block", self.block())
        if self.take(";"):
            return ("block", [])
        if self.take("var", "let", "const"):
            out = self.declaration()
            self.end()
            return out
        if self.take("function"):
            return ("let", [(self.name(), self.function())])
        if self.take("if"):
            self.need("(")
            test = self.expression()
            self.need(")")
            yes = self.block()
            return ("if", test, yes, self.block() if self.take("else") else [])
        if self.take("while"):
            self.need("(")
            test = self.expression()
            self.need(")")
            return ("loop", [], test, None, self.block(), False)
        if self.take("do"):
            body = self.block()
            self.need("while")
            self.need("(")
            test = self.expression()
            self.need(")")
            self.take(";")
            return ("loop", [], test, None, body, True)
        if self.take("for"):
            self.need("(")
            first = []
            if not self.peek(";"):
                first = [self.declaration() if self.take("var", "let", "const") else ("do", self.expression())]
            self.need(";")
            test = ("value", True) if self.peek(";") else self.expression()
            self.need(";")
            step = None if self.peek(")") else self.expression()
            self.need(")")
            return ("loop", first, test, step, self.block(), False)
        if word := self.take("return", "throw"):
            kind, text, line = self.tokens[self.at]
            value = ("value", None) if line or kind == "end" or text in {";", "}"} else self.expression()
            self.end()
            return (word, value)
        if word := self.take("break", "continue"):
            self.end()
            return (word,)
        out = ("do", self.expression())
        self.end()
        return out

    def declaration(self):
        pairs = []
        while True:
            name = self.name()
            pairs.append((name, self.assigned() if self.take("=") else ("value", None)))
            if not self.take(","):
                return ("let", pairs)

    def function(self):
        self.need("(")
        names = []
        while not self.take(")"):
            names.append(self.name())
            self.take(",")
        return ("function", names, self.block())

    def expression(self):
        out = self.assigned()
        while self.take(","):
            out = ("then", out, self.assigned())
        return out

    def assigned(self):
        left = self.choice()
        if op := self.take("=", "+=", "-=", "*=", "/=", "%=", "**="):
            if left[0] not in {"name", "item"}:
                raise ValueError("this can't be assigned in a script")
            right = self.assigned()
            return ("set", left, right if op == "=" else ("binary", op[:-1], left, right))
        return left

    def choice(self):
        test = self.binary(0)
        if not self.take("?"):
            return test
        yes = self.assigned()
        self.need(":")
        return ("choice", test, yes, self.assigned())

    def binary(self, least: int):
        left = self.unary()
        while True:
            kind, op, _ = self.tokens[self.at]
            if kind != "mark" or POWER.get(op, -1) < least or op not in POWER:
                return left
            self.at += 1
            left = ("binary", op, left, self.binary(POWER[op] + (op != "**")))

    def unary(self):
        if op := self.take("-", "+", "!", "typeof"):
            return ("unary", op, self.unary())
        if op := self.take("++", "--"):
            target = self.unary()
            return ("set", target, ("binary", op[0], target, ("value", 1.0)))
        out = self.postfix()
        kind, op, line = self.tokens[self.at]
        if op in {"++", "--"} and kind == "mark" and not line:
            self.at += 1
            return ("after", out, ("set", out, ("binary", op[0], out, ("value", 1.0))))
        return out

    def postfix(self):
        out = self.primary()
        while True:
            if self.take("."):
                kind, text, _ = self.tokens[self.at]
                self.at += 1
                out = ("item", out, ("value", text))
            elif self.take("["):
                out = ("item", out, self.expression())
                self.need("]")
            elif self.take("("):
                given = []
                while not self.take(")"):
                    given.append(self.assigned())
                    self.take(",")
                out = ("call", out, given)
            else:
                return out

    def primary(self):
        kind, text, _ = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return ("value", float(int(text, 16)) if text[:2].lower() == "0x" else float(text))
        if kind == "text":
            inner = re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1]) or (chr(int(m[1][1:], 16)) if len(m[1]) > 1 else m[1]), text[1:-1])
            return ("value", inner)
        if kind == "name":
            if self.take("=>"):
                return ("function", [text], self.block() if self.peek("{") else [("return", self.assigned())])
            return ("name", text)
        if text in {"true", "false"}:
            return ("value", text == "true")
        if text in {"null", "undefined"}:
            return ("value", None)
        if text == "function":
            return self.function()
        if text == "(":
            out = self.expression()
            self.need(")")
            return out
        if text == "[":
            items = []
            while not self.take("]"):
                items.append(self.assigned())
                self.take(",")
            return ("array", items)
        if text == "{":
            pairs = []
            while not self.take("}"):
                key = self.tokens[self.at][1].strip("\"'")
                self.at += 1
                self.need(":")
                pairs.append((key, self.assigned()))
                self.take(",")
            return ("object", pairs)
        raise ValueError(f"unexpected {text!r} in a script")


def number_words(v) -> str:
    """A value as the text that a script joins."""
    if isinstance(v, bool):
        return str(v).lower()
    if v is None:
        return "null"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else ("-" * (v < 0) + "Infinity") if math.isinf(v) else str(int(v)) if v == int(v) and abs(v) < 1e21 else repr(v)
    return ",".join(map(number_words, v)) if isinstance(v, list) else str(v)


def number(v) -> float:
    """A driver value as a number."""
    if isinstance(v, str):
        try:
            return float(v) if v.strip() else 0.0
        except ValueError:
            return math.nan
    return 0.0 if v is None else float(v) if isinstance(v, (bool, int, float)) else math.nan


def column(v) -> Column:
    """Any value as a column."""
    return v if isinstance(v, Column) else F.lit(v)


def quotient(a: float, b: float) -> float:
    """Division without errors."""
    if b:
        return a / b
    return math.nan if not a or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1.0, b)


def rest(a: float, b: float) -> float:
    """Rest with the sign of a."""
    return math.nan if not b or math.isinf(a) else math.fmod(a, b)


def equal(a, b, strict: bool) -> bool:
    """Equality of driver values."""
    if strict and (isinstance(a, str) != isinstance(b, str) or isinstance(a, bool) != isinstance(b, bool)):
        return False
    if isinstance(a, (list, dict)) or isinstance(b, (list, dict)) or a is None or b is None:
        return a is b
    return a == b if isinstance(a, str) and isinstance(b, str) else number(a) == number(b)


DRIVER = {
    "-": lambda a, b: number(a) - number(b), "*": lambda a, b: number(a) * number(b), "/": lambda a, b: quotient(number(a), number(b)),
    "%": lambda a, b: rest(number(a), number(b)), "**": lambda a, b: math.pow(number(a), number(b)),
}
COLUMNS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "%": lambda a, b: a % b, "**": F.pow,
    "/": lambda a, b: F.when(b == 0, a * float("inf")).otherwise(a / b), "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b, "===": lambda a, b: a == b, "!=": lambda a, b: a != b, "!==": lambda a, b: a != b, "&&": lambda a, b: a & b, "||": lambda a, b: a | b,
}
ORDER = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
#: Math functions: for numbers, for columns.
MATH = {
    **{n: (getattr(math, n), getattr(F, n)) for n in ("sqrt", "exp", "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "hypot", "cbrt", "sinh", "cosh", "tanh")},
    "abs": (abs, F.abs), "floor": (lambda a: float(math.floor(a)), F.floor), "ceil": (lambda a: float(math.ceil(a)), F.ceil), "round": (lambda a: float(math.floor(a + 0.5)), lambda c: F.floor(c + 0.5)),
    "log": (math.log, F.ln), "log10": (math.log10, F.log10), "pow": (math.pow, F.pow), "min": (min, F.least), "max": (max, F.greatest), "trunc": (lambda a: float(math.trunc(a)), lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))),
    "sign": (lambda a: float((a > 0) - (a < 0)), F.signum),
}


def math_function(name: str):
    """A function of Math over numbers or columns."""

    def call(*given):
        if any(isinstance(v, Column) for v in given):
            return MATH[name][1](*map(column, given))
        try:
            return float(MATH[name][0](*map(number, given)))
        except (ValueError, OverflowError):
            return math.nan

    return call


KNOWN = {
    "Math": {**{n: math_function(n) for n in MATH}, "PI": math.pi, "E": math.e}, "NaN": math.nan, "Infinity": math.inf,
    "print": lambda *v: LOG.debug(" ".join(map(number_words, v))),
    "parseFloat": number, "parseInt": lambda v, base=10.0: float(int(float(v))) if base == 10 else float(int(str(v), int(base))), "Number": number, "String": number_words, "isNaN": lambda v: math.isnan(number(v)),
}
TEXT_METHODS = {
    "toUpperCase": lambda s: s.upper(), "toLowerCase": lambda s: s.lower(), "trim": lambda s: s.strip(), "indexOf": lambda s, w: float(s.find(w)), "substring": lambda s, a, b=math.inf: s[int(a) : int(min(b, len(s)))],
    "charAt": lambda s, k: s[int(k) : int(k) + 1], "split": lambda s, w: s.split(w) if w else list(s), "replace": lambda s, a, b: s.replace(a, b, 1), "startsWith": lambda s, w: s.startswith(w), "endsWith": lambda s, w: s.endswith(w), "includes": lambda s, w: w in s,
}


class Jump(Exception):
    """break or continue."""


class Script:
    """A parsed script with its variables."""

    def __init__(self, text: str, names: dict | None = None):
        self.body = Parser(text).program()
        self.names = dict(names or {})
        self.outer: dict = {}
        self.steps = 0

    def run(self):
        """Execute; the value of the last expression, or what the script returns."""
        done, value = self.statements(self.body, self.names)
        return value

    def statements(self, body: list, names: dict):
        """(whether something was returned, the value) of statements."""
        value = None
        for k, s in enumerate(body):
            if s[0] == "if" and isinstance(test := self.value(s[1], names), Column):
                return self.both(test, s, body[k + 1 :], names, value)
            if s[0] == "if":
                s = ("block", s[2] if self.truth(test) else s[3])
            done, found = self.statement(s, names)
            if done:
                return True, found
            value = found if found is not None else value
        return False, value

    def both(self, test: Column, s, after: list, names: dict, value):
        """A condition on columns: follow both sides; what they set or return is joined."""
        sides = []
        for part in (s[2], s[3]):
            own = {k: list(v) if isinstance(v, list) else dict(v) if isinstance(v, dict) and k not in KNOWN else v for k, v in names.items()}
            sides.append((*self.statements(part, own), own))
        if sides[0][0] or sides[1][0]:  # one side returns: the rest belongs to the other
            ends = [(d, v) if d else self.statements(after, own) for d, v, own in sides]
            if not all(d for d, _ in ends):
                raise ValueError("a function of columns must return on every way")
            return True, self.joined(test, ends[0][1], ends[1][1])
        for k in {*sides[0][2], *sides[1][2]}:
            a, b = sides[0][2].get(k), sides[1][2].get(k)
            old = names.get(k)
            if isinstance(old, list) and isinstance(a, list) and isinstance(b, list) and len(a) == len(b) == len(old):
                old[:] = [self.joined(test, p, q) for p, q in zip(a, b)]
            else:
                names[k] = self.joined(test, a, b)
        done, found = self.statements(after, names)
        return done, found if found is not None else value

    @staticmethod
    def joined(test: Column, a, b):
        """One of two values by a condition."""
        if a is b:
            return a
        if isinstance(a, (list, dict)) or callable(a) or isinstance(b, (list, dict)) or callable(b):
            if a == b:
                return a
            raise ValueError("a condition on columns can't choose between arrays or functions")
        return F.when(test, column(a)).otherwise(column(b))

    def statement(self, s, names: dict):
        self.count()
        kind = s[0]
        if kind == "do":
            return False, self.value(s[1], names)
        if kind == "let":
            for name, e in s[1]:
                names[name] = self.value(e, names)
            return False, None
        if kind == "block":
            return self.statements(s[1], names)
        if kind == "return":
            return True, self.value(s[1], names)
        if kind == "throw":
            raise ValueError(number_words(self.value(s[1], names)))
        if kind in {"break", "continue"}:
            raise Jump(kind)
        _, first, test, step, body, late = s
        self.statements(first, names)
        while late or self.driver(self.value(test, names)):
            late = False
            try:
                done, found = self.statements(body, names)
                if done:
                    return True, found
            except Jump as j:
                if j.args[0] == "break":
                    break
            if step is not None:
                self.value(step, names)
            self.count()
        return False, None

    def count(self) -> None:
        """One more step."""
        self.steps += 1
        if self.steps > MOST_STEPS:
            raise ValueError("the script takes too many steps")

    def driver(self, v) -> bool:
        """Truth of a loop's condition, which must be known on the driver."""
        if isinstance(v, Column):
            raise ValueError("a loop can't depend on the value of a column")
        return self.truth(v)

    @staticmethod
    def truth(v) -> bool:
        return not (v is None or v is False or v == "" or isinstance(v, (int, float)) and not isinstance(v, bool) and (v == 0 or math.isnan(v)))

    def value(self, e, names: dict):
        kind = e[0]
        if kind == "value":
            return e[1]
        if kind == "name":
            for known in (names, self.names, KNOWN):
                if e[1] in known:
                    return known[e[1]]
            raise ValueError(f"unknown name {e[1]!r} in a script")
        if kind == "binary":
            return self.binary(e, names)
        if kind == "unary":
            v = self.value(e[2], names)
            if e[1] == "typeof":
                return "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "number" if isinstance(v, float) else "undefined" if v is None else "function" if callable(v) else "object"
            if isinstance(v, Column):
                return {"-": lambda: -v, "+": lambda: v.cast("double"), "!": lambda: ~v}[e[1]]()
            return not self.truth(v) if e[1] == "!" else -number(v) if e[1] == "-" else number(v)
        if kind == "choice":
            test = self.value(e[1], names)
            if isinstance(test, Column):
                return self.joined(test, self.value(e[2], names), self.value(e[3], names))
            return self.value(e[2] if self.truth(test) else e[3], names)
        if kind == "set":
            return self.put(e[1], self.value(e[2], names), names)
        if kind == "after":
            old = self.value(e[1], names)
            self.value(e[2], names)
            return old
        if kind == "then":
            self.value(e[1], names)
            return self.value(e[2], names)
        if kind == "array":
            return [self.value(x, names) for x in e[1]]
        if kind == "object":
            return {k: self.value(x, names) for k, x in e[1]}
        if kind == "function":
            return self.closure(e[1], e[2], names)
        if kind == "item":
            return self.item(self.value(e[1], names), self.value(e[2], names))
        function = self.value(e[1], names)
        if not callable(function):
            raise ValueError("this is no function in a script")
        return function(*[self.value(x, names) for x in e[2]])

    def binary(self, e, names: dict):
        op, a = e[1], self.value(e[2], names)
        if op in {"&&", "||"} and not isinstance(a, Column):
            return self.value(e[3], names) if self.truth(a) == (op == "&&") else a
        b = self.value(e[3], names)
        if isinstance(a, Column) or isinstance(b, Column):
            if op == "+" and (isinstance(a, str) or isinstance(b, str)):
                return F.concat(column(a).cast("string"), column(b).cast("string"))
            return COLUMNS[op](column(a), column(b))
        if op == "+":
            return number_words(a) + number_words(b) if isinstance(a, (str, list)) or isinstance(b, (str, list)) else number(a) + number(b)
        if op in ORDER:
            return ORDER[op](a, b) if isinstance(a, str) and isinstance(b, str) else ORDER[op](number(a), number(b))
        if op in {"==", "===", "!=", "!=="}:
            return equal(a, b, len(op) == 3) == (op[0] == "=")
        return DRIVER[op](a, b)

    def closure(self, params: list[str], body: list, names: dict):
        def call(*given):
            own = {**names, **dict(zip(params, [*given, *[None] * len(params)]))}
            done, value = self.statements(body, own)
            for k in names:  # variables around the function keep what it sets
                if k not in params and k in own:
                    names[k] = own[k]
            return value if done else None

        return call

    @staticmethod
    def item(owner, key):
        if isinstance(owner, list):
            if key == "length":
                return float(len(owner))
            if key == "push":
                return lambda *v: (owner.extend(v), float(len(owner)))[1]
            if key == "join":
                return lambda w=",": w.join(map(number_words, owner))
            k = int(number(key))
            return owner[k] if 0 <= k < len(owner) else None
        if isinstance(owner, str):
            if key == "length":
                return float(len(owner))
            if key in TEXT_METHODS:
                return lambda *v: TEXT_METHODS[key](owner, *v)
            return owner[int(number(key)) : int(number(key)) + 1]
        if isinstance(owner, dict):
            return owner.get(key if isinstance(key, str) else number_words(key))
        raise ValueError(f"no {key!r} in this value of a script")

    def put(self, target, v, names: dict):
        if target[0] == "name":
            names[target[1]] = v
            return v
        if target[0] != "item":
            raise ValueError("this can't be assigned in a script")
        owner, key = self.value(target[1], names), self.value(target[2], names)
        if isinstance(owner, list):
            k = int(number(key))
            owner.extend([None] * (k + 1 - len(owner)))
            owner[k] = v
        elif isinstance(owner, dict) and not any(owner is k for k in KNOWN.values()):
            owner[key if isinstance(key, str) else number_words(key)] = v
        else:
            raise ValueError("this can't be assigned in a script")
        return v

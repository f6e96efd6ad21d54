"""Per-voxel expressions: a small calculator language, parsed here and built as a Column.

Names: vox, pos_x, pos_y, pos_z, pos_t, pi (_pi), e (_e).  Operators by rising rank: ``?:``, ``||``, ``&&``, comparisons, ``+ -``, ``* /``,
unary minus, ``^`` (from the right).  Everything is computed in doubles; truth is 1 and 0.  Only listed functions are known, so
no text reaches the SQL parser.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(<=|>=|==|!=|&&|\|\||[-+*/^()<>,?:]))")


def _fold(f: Callable) -> Callable:
    def run(*a: Column) -> Column:
        out = a[0]
        for x in a[1:]:
            out = f(out, x)
        return out

    return run


FUNCTIONS: dict[str, Callable[..., Column]] = {
    **{n: getattr(F, n) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "exp", "sqrt", "abs", "log2", "log10", "rint")},
    "log": F.log10, "ln": F.log, "sign": F.signum, "atan2": F.atan2,
    "min": _fold(F.least), "max": _fold(F.greatest), "sum": _fold(lambda a, b: a + b),
    "avg": lambda *a: _fold(lambda x, y: x + y)(*a) / len(a),
}
CONSTANTS = {"pi": math.pi, "_pi": math.pi, "e": math.e, "_e": math.e}


class ExpressionError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str, names: dict[str, Column]) -> None:
        self.names, self.tokens, at = names, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"unexpected {text[at]!r} at {at}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][3] if self.at < len(self.tokens) else None

    def take(self, *signs: str) -> str | None:
        if (s := self.peek()) in signs and s is not None:
            self.at += 1
            return s
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ExpressionError(f"expected {sign!r}")

    def choice(self) -> Column:
        test = self.binary(0)
        if not self.take("?"):
            return test
        yes = self.choice()
        self.need(":")
        return F.when(test != 0, yes).otherwise(self.choice())

    LEVELS = (("||",), ("&&",), ("<", ">", "<=", ">=", "==", "!="), ("+", "-"), ("*", "/"))

    def binary(self, level: int) -> Column:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while sign := self.take(*self.LEVELS[level]):
            left = self.join(sign, left, self.binary(level + 1))
        return left

    @staticmethod
    def join(sign: str, a: Column, b: Column) -> Column:
        if sign == "/":  # division by zero is infinite or NaN, as doubles have it
            zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
            return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).otherwise(zero)
        plain = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}
        if sign in plain:
            return plain[sign]()
        truth = {"||": lambda: (a != 0) | (b != 0), "&&": lambda: (a != 0) & (b != 0), "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "==": lambda: a == b, "!=": lambda: a != b}
        return truth[sign]().cast("double")

    def unary(self) -> Column:
        if self.take("-"):
            return -self.unary()
        if self.take("+"):
            return self.unary()
        base = self.atom()
        return F.pow(base, self.unary()) if self.take("^") else base

    def atom(self) -> Column:
        if self.at == len(self.tokens):
            raise ExpressionError("the expression ends too early")
        number, name, _ = self.tokens[self.at].groups()
        if number:
            self.at += 1
            return F.lit(float(number))
        if name:
            self.at += 1
            if self.take("("):
                if name not in FUNCTIONS:
                    raise ExpressionError(f"unknown function {name}")
                values = [self.choice()]
                while self.take(","):
                    values.append(self.choice())
                self.need(")")
                return FUNCTIONS[name](*values)
            if name in self.names:
                return self.names[name]
            if name in CONSTANTS:
                return F.lit(CONSTANTS[name])
            raise ExpressionError(f"unknown name {name}")
        self.need("(")
        inner = self.choice()
        self.need(")")
        return inner


def voxel_expression(text: str, vox: Column, x: Column, y: Column, z: Column, t: Column) -> Column:
    """The expression as a double Column."""
    names = {k: c.cast("double") for k, c in (("vox", vox), ("pos_x", x), ("pos_y", y), ("pos_z", z), ("pos_t", t))}
    parser = _Parser(text, names)
    out = parser.choice()
    if parser.at != len(parser.tokens):
        raise ExpressionError("the expression goes on after its end")
    return out

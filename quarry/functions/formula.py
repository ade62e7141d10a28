"""Ranking formulas: arithmetic over named scores, compiled to a column."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from quarry.plans.nodes import QueryError

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_][A-Za-z0-9_]*)|\{([^{}]+)\}|([-+*/^(),]))")
_ONE = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "ln": F.ln, "log": F.ln, "log2": F.log2, "log10": F.log10, "log1p": F.log1p, "expm1": F.expm1, "floor": F.floor,
    "ceil": F.ceil, "round": F.round, "trunc": lambda x: F.signum(x) * F.floor(F.abs(x)), "fract": lambda x: x - F.signum(x) * F.floor(F.abs(x)), "signum": F.signum,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
}
_TWO = {"min": F.least, "max": F.greatest}
_CONSTANTS = {"PI": math.pi, "E": math.e, "TAU": 2 * math.pi}
LONGEST, MOST_TOKENS, DEEPEST, MOST_VARIABLES = 4096, 256, 32, 16


class Formula:
    """A checked formula. Signs bind before powers, so -x^2 is (-x)^2."""

    def __init__(self, text: str) -> None:
        if not text.strip() or len(text.encode()) > LONGEST:
            raise QueryError("a formula has 1 to 4096 bytes")
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at : at + 10]!r} in the formula")
            self.tokens.append(("number", "name", "braced", "op")[next(i for i in range(4) if m.group(i + 1) is not None)] + ":" + next(g for g in m.groups() if g is not None))
            at = m.end()
        if len(self.tokens) > MOST_TOKENS:
            raise QueryError(f"a formula has at most {MOST_TOKENS} tokens")
        self.at, self.depth = 0, 0
        self.tree = self._sum()
        if self.at < len(self.tokens):
            raise QueryError(f"unexpected {self.tokens[self.at]!r} in the formula")
        self.variables = sorted({x for x in self._names(self.tree)})
        if len(set(self.variables) - {"rrf"}) > MOST_VARIABLES:
            raise QueryError(f"a formula has at most {MOST_VARIABLES} variables")
        if not self.variables:
            self.value({})

    def _op(self, *which: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at].startswith("op:") and self.tokens[self.at][3:] in which:
            self.at += 1
            return self.tokens[self.at - 1][3:]
        return None

    def _need(self, which: str) -> None:
        if not self._op(which):
            raise QueryError(f"{which!r} expected in the formula")

    def _sum(self):
        left = self._product()
        while op := self._op("+", "-"):
            left = (op, left, self._product())
        return left

    def _product(self):
        left = self._power()
        while op := self._op("*", "/"):
            left = (op, left, self._power())
        return left

    def _power(self):
        left = self._signed()
        while self._op("^"):
            left = ("^", left, self._signed())
        return left

    def _signed(self):
        if op := self._op("-", "+"):
            inner = self._signed()
            return ("neg", inner) if op == "-" else inner
        if self.at == len(self.tokens):
            raise QueryError("the formula ends too soon")
        kind, _, word = self.tokens[self.at].partition(":")
        self.at += 1
        if kind == "number":
            return ("number", float(word))
        if kind == "braced":
            return ("name", word)
        if kind == "name":
            if word in _ONE or word in _TWO:
                self._need("(")
                inner = self._inside(word in _TWO)
                return (word, *inner)
            return ("number", _CONSTANTS[word]) if word in _CONSTANTS else ("name", word)
        if word == "(":
            return self._inside(False)[0]
        raise QueryError(f"unexpected {word!r} in the formula")

    def _inside(self, two: bool):
        self.depth += 1
        if self.depth > DEEPEST:
            raise QueryError(f"a formula is at most {DEEPEST} deep")
        out = [self._sum()]
        if two:
            self._need(",")
            out.append(self._sum())
        self._need(")")
        self.depth -= 1
        return out

    def _names(self, tree):
        if tree[0] == "name":
            yield tree[1]
        elif tree[0] != "number":
            for x in tree[1:]:
                yield from self._names(x)

    def column(self, scores: Mapping[str, Column], missing: Mapping[str, float] | None = None) -> Column:
        """The formula over score columns; nulls take their name's value in missing, or 0. Not-finite results are an error."""
        if unknown := set(self.variables) - set(scores):
            raise QueryError(f"the formula names no branch {sorted(unknown)}")
        missing = missing or {}
        known = {k: F.coalesce(c.cast("double"), F.lit(float(missing.get(k, 0.0)))) for k, c in scores.items()}
        out = self._column(self.tree, known)
        fine = out.isNotNull() & ~F.isnan(out) & (F.abs(out) < F.lit(float("inf")))
        return F.when(fine, out).otherwise(F.raise_error(F.lit("the formula has no finite value for a candidate")).cast("double"))

    def _column(self, tree, known: dict[str, Column]) -> Column:
        kind = tree[0]
        if kind == "number":
            return F.lit(tree[1])
        if kind == "name":
            return known[tree[1]]
        args = [self._column(x, known) for x in tree[1:]]
        if kind == "neg":
            return -args[0]
        if kind in _ONE:
            return _ONE[kind](args[0]).cast("double")
        if kind in _TWO:
            return _TWO[kind](*args)
        a, b = args
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b != 0, a / F.nullif(b, F.lit(0.0))), "^": lambda: F.pow(a, b)}[kind]()

    def value(self, scores: Mapping[str, float]) -> float:
        """The formula of plain numbers."""

        def run(tree) -> float:
            kind = tree[0]
            if kind == "number":
                return tree[1]
            if kind == "name":
                return float(scores.get(tree[1], 0.0))
            args = [run(x) for x in tree[1:]]
            if kind == "neg":
                return -args[0]
            plain = {"ln": math.log, "log": math.log, "abs": abs, "round": round, "min": min, "max": max, "signum": lambda x: (x > 0) - (x < 0), "fract": lambda x: x - math.trunc(x)}
            if kind in plain or kind in _ONE:
                return float((plain.get(kind) or getattr(math, kind))(*args))
            return {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "^": lambda a, b: a**b}[kind](*args)

        try:
            out = run(self.tree)
        except (ValueError, ZeroDivisionError, OverflowError) as e:
            raise QueryError(f"the formula has no finite value: {e}") from e
        if isinstance(out, complex) or not math.isfinite(out):
            raise QueryError("the formula has no finite value")
        return out

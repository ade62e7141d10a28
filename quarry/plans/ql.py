"""The query language: a string to a logical query, by recursive descent.

Terms, "phrases", field:..., prefix*, wild?cards, regex("..."), wildcard("..."), groups, AND, OR,
NOT, + and -, field:ann([...]) and field:sparse({...}). White space between clauses is OR.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from quarry.plans import patterns
from quarry.plans.nodes import Boolean, Dense, Match, Node, Phrase, Prefix, QueryError, Regex, Sparse, Term, Wildcard

_FIELD = re.compile(r"([A-Za-z][A-Za-z0-9_]*):")
_WORD = re.compile(r"(?:[^\W_]|[_\-.']|\\.)+", re.S)
_PATTERN = re.compile(r'(?:\\.|[^\s"()*?])*[*?](?:\\.|[^\s"()])*', re.S)
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_NUMBER = re.compile(r"-?[0-9]+(?:\.[0-9]+)?")
_KEYWORD_END = re.compile(r'(?=[\s("]|$)')


class _Malformed(QueryError):
    """Syntax that must not be taken for free text."""


@dataclass
class _Parsed:
    node: Node
    sign: str = ""  # "+" or "-"


def _unescaped(text: str) -> str:
    if re.search(r"(?<!\\)(?:\\\\)*\\$", text):
        raise _Malformed("a backslash at the end quotes nothing")
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class _Parser:
    def __init__(self, text: str, fields: Sequence[str]) -> None:
        self.text, self.at, self.fields = text, 0, tuple(fields)

    # Characters

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
            self.at += 1

    def take(self, pattern: re.Pattern | str) -> str | None:
        if isinstance(pattern, str):
            if self.text.startswith(pattern, self.at):
                self.at += len(pattern)
                return pattern
            return None
        m = pattern.match(self.text, self.at)
        if m and m.end() > self.at:
            self.at = m.end()
            return m.group()
        return None

    def need(self, what: str) -> None:
        self.space()
        if self.take(what) is None:
            raise QueryError(f"{what!r} expected at {self.at} of {self.text!r}")

    def keyword(self, word: str, symbol: str) -> bool:
        self.space()
        if self.take(symbol):
            return True
        end = self.at + len(word)
        if self.text.startswith(word, self.at) and _KEYWORD_END.match(self.text, end):
            self.at = end
            return True
        return False

    # Grammar

    def query(self) -> Node:
        node = self.any_of()
        self.space()
        if self.at < len(self.text):
            raise QueryError(f"unexpected {self.text[self.at :][:20]!r}")
        return node.node

    def any_of(self) -> _Parsed:
        parts = [self.all_of()]
        while True:
            explicit = self.keyword("OR", "||")
            self.space()
            if not explicit and (self.at == len(self.text) or self.text[self.at] == ")"):
                break
            parts.append(self.all_of())
        if len(parts) == 1 and not parts[0].sign:
            return parts[0]
        return _Parsed(self.group(parts, "should"))

    def all_of(self) -> _Parsed:
        parts = [self.primary()]
        while self.keyword("AND", "&&"):
            parts.append(self.primary())
        return parts[0] if len(parts) == 1 else _Parsed(self.group(parts, "must"))

    def group(self, parts: list[_Parsed], plain: str) -> Node:
        # Bare punctuation among other clauses is text without a token.
        spoken = [p for p in parts if p.sign or not (isinstance(p.node, Term) and not any(map(str.isalnum, p.node.text)))]
        parts = spoken or parts
        kinds = {"must": [p.node for p in parts if p.sign == "+"], "should": [], "must_not": [p.node for p in parts if p.sign == "-"]}
        kinds[plain] += [p.node for p in parts if not p.sign]
        return Boolean(**{k: tuple(v) for k, v in kinds.items()})

    def primary(self) -> _Parsed:
        self.space()
        sign, start = "", self.at
        if self.at < len(self.text) and self.text[self.at] in "+-" and self.text[self.at + 1 : self.at + 2].strip():
            sign = self.text[self.at]
            self.at += 1
        elif self.keyword("NOT", "!"):
            sign = "!"
        elif self.at + 1 <= len(self.text) and self.text[self.at : self.at + 1] == "+":
            raise (_Malformed if self.at + 1 == len(self.text) and self.text.strip() == "+" else QueryError)("a bare + marks nothing")
        self.space()
        try:
            if sign and self.text[self.at : self.at + 1] in ("+", "-", "!"):
                raise QueryError("two signs in a row")
            node = self.operand()
        except QueryError as e:
            if sign in ("+", "-"):
                raise _Malformed(f"{self.text[start:][:20]!r}: {e}") from e
            raise
        return _Parsed(Boolean(must_not=(node,))) if sign == "!" else _Parsed(node, sign)

    def operand(self) -> Node:
        if self.take("("):
            node = self.any_of()
            self.need(")")
            return node.node
        name = None
        if m := _FIELD.match(self.text, self.at):
            name, self.at = m.group(1), m.end()
            self.space()
        if name and self.take("ann("):
            return self.vector(name)
        if name and self.take("sparse("):
            return self.sparse(name)
        for call, kind in (("regex", Regex), ("wildcard", Wildcard)):
            if self.text.startswith(call + "(", self.at):
                self.at += len(call) + 1
                try:
                    self.space()
                    quoted = self.take(_STRING)
                    if quoted is None:
                        raise QueryError("a quoted pattern is expected")
                    pattern = json.loads(quoted)
                    self.need(")")
                    (patterns.regex if kind is Regex else patterns.wildcard)(pattern)
                except (QueryError, json.JSONDecodeError) as e:
                    raise _Malformed(f"{call}: {e}") from e
                return self.over(name, lambda f: kind(f, pattern.lower() if kind is Wildcard else pattern))
        if quoted := self.take(_STRING):
            inner = _unescaped(quoted[1:-1])
            return self.over(name, lambda f: Phrase(f, inner))
        if pattern := self.take(_PATTERN):
            head = pattern[:-1]
            if pattern.endswith("*") and head and not re.search(r"(?<!\\)[*?]", head):
                return self.over(name, lambda f: Prefix(f, _unescaped(head).lower()))
            return self.over(name, lambda f: Wildcard(f, pattern.lower()))
        word = self.take(_WORD)
        if word is None:
            if self.text[self.at : self.at + 1] == "\\":
                raise _Malformed("a backslash at the end quotes nothing")
            raise QueryError(f"a clause is expected at {self.at} of {self.text!r}")
        if self.text[self.at : self.at + 1] == "\\":
            raise _Malformed("a backslash at the end quotes nothing")
        plain = _unescaped(word)
        return self.over(name, lambda f: Term(f, plain))

    def over(self, name: str | None, make) -> Node:
        """The clause over its field, or over each default field."""
        if name:
            return make(name)
        if not self.fields:
            raise QueryError("a field is needed, as there is no default one")
        return make(self.fields[0]) if len(self.fields) == 1 else Boolean(should=tuple(make(f) for f in self.fields))

    def number(self) -> float:
        self.space()
        got = self.take(_NUMBER)
        if got is None:
            raise QueryError(f"a number is expected at {self.at} of {self.text!r}")
        return float(got)

    def options(self) -> None:
        self.space()
        while self.take(","):
            self.space()
            for name in ("k", "nprobe", "rerank"):
                if self.take(name + "="):
                    break
            self.number()  # how hard an approximate index should try: the answer here is exact
            self.space()
        self.need(")")

    def vector(self, name: str) -> Node:
        self.need("[")
        values = [self.number()]
        self.space()
        while self.take(","):
            values.append(self.number())
            self.space()
        self.need("]")
        self.options()
        return Dense(name, tuple(values))

    def sparse(self, name: str) -> Node:
        self.need("{")
        entries = []
        while True:
            dim = self.number()
            self.need(":")
            entries.append((int(dim), self.number()))
            self.space()
            if not self.take(","):
                break
        self.need("}")
        self.options()
        return Sparse(name, tuple(entries))


def parse_strict(text: str, fields: Sequence[str] = ()) -> Node:
    """A query string to a query; every error is told. fields: where unqualified clauses look."""
    if not text.strip():
        return Boolean()
    return _Parser(text, fields).query()


def parse(text: str, fields: Sequence[str] = ()) -> Node:
    """As parse_strict(), but what isn't query syntax is free text: any of its words.

    A malformed sign, escape or pattern call is an error still.
    """
    try:
        return parse_strict(text, fields)
    except _Malformed:
        raise
    except QueryError:
        if not fields:
            raise
        each = tuple(Match(f, text) for f in fields)
        return each[0] if len(each) == 1 else Boolean(should=each)



"""Logical queries: immutable trees that the planner turns into columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from quarry.functions.scoring import Combiner


class QueryError(ValueError):
    """A query that can't be run, and why."""


@dataclass(frozen=True)
class Node:
    pass


def _check_boost(boost: float) -> None:
    if not (math.isfinite(boost) and boost >= 0):
        raise QueryError("a field's boost is a finite number, not below 0")


@dataclass(frozen=True)
class All(Node):
    """Every document, with score 1."""


@dataclass(frozen=True)
class Term(Node):
    """A token of a field. Text of several tokens needs them all; text without any is an error.

    A field that is fast but not indexed is compared as a whole, as a filter with score 1.
    field_boost multiplies the token's count inside the saturation of its score.
    """

    field: str
    text: str
    field_boost: float = 1.0

    def __post_init__(self) -> None:
        _check_boost(self.field_boost)


@dataclass(frozen=True)
class Match(Node):
    """Any token of a text. Repeated tokens weigh as often; beyond max_terms only the rarest count.

    proximity_weight adds that much of the score that neighbouring query words get for standing
    in order (next to each other) and near (within proximity_window).
    """

    field: str
    text: str
    max_terms: int | None = None  # the field's, if not given
    proximity_weight: float = 0.0
    proximity_window: int = 8
    field_boost: float = 1.0

    def __post_init__(self) -> None:
        _check_boost(self.field_boost)
        if self.max_terms is not None and not 1 <= self.max_terms <= 64:
            raise QueryError("max_terms goes from 1 to 64")


@dataclass(frozen=True)
class Phrase(Node):
    """Tokens at their distances; each later one may be up to slop positions off its place."""

    field: str
    text: str
    slop: int = 0


@dataclass(frozen=True)
class Prefix(Node):
    field: str
    prefix: str

    def __post_init__(self) -> None:
        if not self.prefix:
            raise QueryError("a prefix needs a character")


@dataclass(frozen=True)
class Wildcard(Node):
    """Whole tokens: * is any run, ? any character, a backslash quotes."""

    field: str
    pattern: str


@dataclass(frozen=True)
class Regex(Node):
    """Whole tokens by a restricted regular expression, case-sensitive."""

    field: str
    pattern: str


@dataclass(frozen=True)
class Range(Node):
    """Both ends included; an open end is None. Without ends: the field has a value."""

    field: str
    low: float | int | None = None
    high: float | int | None = None


@dataclass(frozen=True)
class Boolean(Node):
    must: tuple[Node, ...] = ()
    should: tuple[Node, ...] = ()
    must_not: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Boost(Node):
    query: Node
    factor: float

    def __post_init__(self) -> None:
        if not math.isfinite(self.factor):
            raise QueryError("a boost is a finite number")


@dataclass(frozen=True)
class Filtered(Node):
    """The query among documents that pass all filters, which add no score."""

    query: Node
    filters: tuple[Node, ...]

    def __post_init__(self) -> None:
        if len(self.filters) > 64:
            raise QueryError("at most 64 filters")


@dataclass(frozen=True)
class Sparse(Node):
    """Sum of products over shared dims."""

    field: str
    entries: tuple[tuple[int, float], ...]
    combiner: Combiner = Combiner("log_sum_exp")

    def __post_init__(self) -> None:
        if not all(math.isfinite(w) for _, w in self.entries):
            raise QueryError("weights are finite")


@dataclass(frozen=True)
class Dense(Node):
    """Cosine similarity. Every vector matches."""

    field: str
    vector: tuple[float, ...]
    combiner: Combiner = Combiner("max")

    def __post_init__(self) -> None:
        if not self.vector or not all(map(math.isfinite, self.vector)):
            raise QueryError("a query vector has finite components")


@dataclass(frozen=True)
class Binary(Node):
    """1 - Hamming distance / bits, of codes in 64-bit words."""

    field: str
    words: tuple[int, ...]
    bits: int
    combiner: Combiner = Combiner("max")


@dataclass(frozen=True)
class Branch:
    query: Node
    weight: float = 1.0
    name: str | None = None
    scope: str = "document"
    score_only: bool = False


@dataclass(frozen=True)
class Fusion(Node):
    """Several ranked lists as one: reciprocal ranks, or sums of scores scaled to 0..1."""

    branches: tuple[Branch, ...]
    method: str = "rrf"
    k: float = 60.0
    depth: int = 1000
    combiner: Combiner = Combiner("max")

    def __post_init__(self) -> None:
        if not 1 <= len(self.branches) <= 16:
            raise QueryError("a fusion has 1 to 16 branches")
        if self.method not in ("rrf", "normalized_weighted_sum", "candidates"):
            raise QueryError(f"unknown fusion method {self.method!r}")


CONSTANT = (All, Range, Prefix, Wildcard, Regex)


def flattened(node: Node) -> Node:
    """Without needless levels: lone clauses stand alone, SHOULD within SHOULD is one group."""
    if isinstance(node, Boolean):
        must, should, must_not = (tuple(map(flattened, x)) for x in (node.must, node.should, node.must_not))
        flat: list[Node] = []
        for clause in should:
            nested = isinstance(clause, Boolean) and clause.should and not clause.must and not clause.must_not
            flat += clause.should if nested else [clause]
        if len(must) + len(flat) == 1 and not must_not:
            return (must + tuple(flat))[0]
        return Boolean(must, tuple(flat), must_not)
    if isinstance(node, Boost):
        return Boost(flattened(node.query), node.factor)
    if isinstance(node, Filtered):
        return Filtered(flattened(node.query), tuple(map(flattened, node.filters)))
    return node


def walk(node: Node):
    """The node and all below it."""
    yield node
    if isinstance(node, Boolean):
        for x in (*node.must, *node.should, *node.must_not):
            yield from walk(x)
    elif isinstance(node, Boost):
        yield from walk(node.query)
    elif isinstance(node, Filtered):
        for x in (node.query, *node.filters):
            yield from walk(x)
    elif isinstance(node, Fusion):
        for b in node.branches:
            yield from walk(b.query)

"""Structured queries: dicts with one key each, checked against the request limits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from quarry.functions.scoring import Combiner
from quarry.plans import nodes as N
from quarry.plans.nodes import QueryError

# Request limits.
MOST_RESULTS, MOST_WINDOW, DEEPEST, MOST_NODES, MOST_CLAUSES, MOST_IN_BOOLEAN = 10_000, 50_000, 32, 256, 512, 128
MOST_TEXT, MOST_NAME, MOST_DIMS, MOST_ENTRIES, MOST_CODE, MOST_FIELDS = 65_536, 255, 65_536, 4_096, 262_144, 64

#: Options of approximate indexes. They are checked and then not needed: answers are exact.
_EFFORT = {"heap_factor": (0.0, 1.0), "time_budget_ms": (0, math.inf), "lsp_gamma": (0, math.inf), "nprobe": (1, 65_536), "seismic_cut": (1, 64), "seismic_factor": (0.0, math.inf), "rerank_factor": (1.0, 2.0), "exhaustive": (0, 1)}


#: What each kind of query may say, beside the options above.
_KEYS = {
    "all": "", "term": "field term field_boost", "match": "field text max_terms proximity_weight proximity_window field_boost", "phrase": "field text slop", "prefix": "field prefix",
    "range": "field min max min_u64 max_u64 min_i64 max_i64 min_f64 max_f64", "boost": "query boost", "boolean": "must should must_not",
    "sparse_vector": "field indices values weight_threshold pruning max_query_dims min_query_dims combiner", "dense_vector": "field vector combiner",
    "binary_dense_vector": "field words bits combiner", "fusion": "queries method rrf_k depth combiner",
}
_BRANCH = "query weight name scope score_only"


def _only(what: str, body: Mapping[str, Any], keys: str) -> None:
    if unknown := sorted(set(body) - set(keys.split())):
        raise QueryError(f"{what} knows no {', '.join(map(repr, unknown))}")


def page(limit: int = 10, offset: int = 0) -> tuple[int, int]:
    if not 0 <= limit <= MOST_RESULTS or offset < 0 or limit + offset > MOST_WINDOW:
        raise QueryError(f"limit goes to {MOST_RESULTS}, limit and offset to {MOST_WINDOW}")
    return limit, offset


def loaded(fields: Sequence[str]) -> list[str]:
    if len(fields) > MOST_FIELDS or any(len(f.encode()) > MOST_NAME for f in fields):
        raise QueryError(f"at most {MOST_FIELDS} fields of {MOST_NAME} bytes")
    return list(fields)


def combiner(spec: Any, default: Combiner) -> Combiner:
    if spec is None:
        return default
    if isinstance(spec, str):
        return Combiner(spec)
    if isinstance(spec, Mapping):
        return Combiner(**spec)
    raise QueryError("a combiner is a name or a dict")


class _Builder:
    def __init__(self) -> None:
        self.nodes = self.clauses = 0

    def build(self, spec: Mapping[str, Any], depth: int = 1, top: bool = False) -> N.Node:
        self.nodes += 1
        if depth > DEEPEST or self.nodes > MOST_NODES:
            raise QueryError(f"a query is at most {DEEPEST} deep and of {MOST_NODES} parts")
        if not isinstance(spec, Mapping) or len(spec) != 1:
            raise QueryError("a query is a dict with exactly one key")
        (kind, body), *_ = spec.items()
        make = getattr(self, f"_{kind}") if kind in _KEYS else None
        if make is None or kind == "fusion" and not top:
            raise QueryError(f"unknown query {kind!r}" if make is None else "a fusion stands at the top alone")
        body = dict(body or {})
        for name, (low, high) in _EFFORT.items():
            if name in body and not low <= float(body.pop(name)) <= high:
                raise QueryError(f"{name} goes from {low} to {high}")
        _only(kind, body, _KEYS[kind])
        try:
            return make(body, depth)
        except (KeyError, TypeError) as e:
            raise QueryError(f"{kind}: {e}") from e

    def text(self, body: dict, key: str) -> str:
        value = body[key]
        if not isinstance(value, str) or len(value.encode()) > MOST_TEXT:
            raise QueryError(f"{key} is a text of at most {MOST_TEXT} bytes")
        return value

    def _all(self, body: dict, depth: int) -> N.Node:
        return N.All()

    def _term(self, body: dict, depth: int) -> N.Node:
        return N.Term(body["field"], self.text(body, "term"), float(body.get("field_boost", 1)))

    def _match(self, body: dict, depth: int) -> N.Node:
        text = self.text(body, "text")
        if text.endswith("*"):  # a prefix, as it stands
            return N.Prefix(body["field"], text[:-1].lower())
        most = int(body["max_terms"]) if body.get("max_terms") else None
        return N.Match(body["field"], text, most, float(body.get("proximity_weight", 0)), int(body.get("proximity_window", 8)), float(body.get("field_boost", 1)))

    def _phrase(self, body: dict, depth: int) -> N.Node:
        return N.Phrase(body["field"], self.text(body, "text"), int(body.get("slop", 0)))

    def _prefix(self, body: dict, depth: int) -> N.Node:
        return N.Prefix(body["field"], self.text(body, "prefix").lower())

    def _range(self, body: dict, depth: int) -> N.Node:
        ends = {k: next((body[f"{k}_{t}"] for t in ("u64", "i64", "f64") if f"{k}_{t}" in body), body.get(k)) for k in ("min", "max")}
        return N.Range(body["field"], ends["min"], ends["max"])

    def _boost(self, body: dict, depth: int) -> N.Node:
        return N.Boost(self.build(body["query"], depth + 1), float(body["boost"]))

    def _boolean(self, body: dict, depth: int) -> N.Node:
        groups = {k: list(body.get(k) or ()) for k in ("must", "should", "must_not")}
        n = sum(map(len, groups.values()))
        self.clauses += n
        if n > MOST_IN_BOOLEAN or self.clauses > MOST_CLAUSES:
            raise QueryError(f"a Boolean has at most {MOST_IN_BOOLEAN} clauses, a query {MOST_CLAUSES}")
        return N.Boolean(**{k: tuple(self.build(x, depth + 1) for x in v) for k, v in groups.items()})

    def _sparse_vector(self, body: dict, depth: int) -> N.Node:
        dims, weights = list(body["indices"]), list(body["values"])
        if len(dims) != len(weights) or len(dims) > MOST_ENTRIES:
            raise QueryError(f"a sparse vector has as many indices as values, {MOST_ENTRIES} at most")
        entries = pruned(list(zip(dims, weights)), body.get("weight_threshold", 0.0), body.get("pruning", 1.0), body.get("max_query_dims"), body.get("min_query_dims", 4))
        return N.Sparse(body["field"], tuple(entries), combiner(body.get("combiner"), Combiner("log_sum_exp")))

    def _dense_vector(self, body: dict, depth: int) -> N.Node:
        if len(body["vector"]) > MOST_DIMS:
            raise QueryError(f"a vector has at most {MOST_DIMS} components")
        return N.Dense(body["field"], tuple(map(float, body["vector"])), combiner(body.get("combiner"), Combiner("log_sum_exp")))

    def _binary_dense_vector(self, body: dict, depth: int) -> N.Node:
        words = tuple(map(int, body["words"]))
        if len(words) * 8 > MOST_CODE:
            raise QueryError(f"a code has at most {MOST_CODE} bytes")
        return N.Binary(body["field"], words, int(body.get("bits", 64 * len(words))), combiner(body.get("combiner"), Combiner("log_sum_exp")))

    def _fusion(self, body: dict, depth: int) -> N.Node:
        branches = []
        for b in body["queries"]:
            _only("a branch", b, _BRANCH)
            if b.get("scope", "document") not in ("document", "chunk"):
                raise QueryError("a branch's scope is document or chunk")
            branches.append(N.Branch(self.build(b["query"], depth + 1), float(b.get("weight", 1.0)), b.get("name"), b.get("scope", "document"), bool(b.get("score_only", False))))
        return N.Fusion(tuple(branches), body.get("method", "rrf"), float(body.get("rrf_k", 60)), int(body.get("depth", 1000)), combiner(body.get("combiner"), Combiner("max")))


def build(spec: Mapping[str, Any]) -> N.Node:
    """A dict query to a query; anything unknown or beyond the limits is an error."""
    return _Builder().build(spec, top=True)


def pruned(entries: list[tuple[int, float]], threshold: float = 0.0, share: float = 1.0, most: int | None = None, least: int = 4) -> list[tuple[int, float]]:
    """A sparse query without its light dims: below the threshold, beyond a share, beyond a number.

    The threshold holds only for queries of more than ``least`` dims. What stays is the
    heaviest, ties to the smaller dim; one dim stays at least.
    """
    if len(entries) > least:
        entries = [e for e in entries if abs(e[1]) >= threshold] or entries[:0]
    ordered = sorted(entries, key=lambda e: (-abs(e[1]), e[0]))
    if share < 1 and ordered:
        ordered = ordered[: max(1, math.ceil(len(ordered) * share))]
    return ordered[:most] if most else ordered

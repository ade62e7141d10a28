"""The engine: indexes by name, structured and string queries, results as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from quarry.operators import ranking
from quarry.plans import nodes as N, planner, request, router
from quarry.plans.nodes import QueryError
from quarry.plans.planner import Index
from quarry.schema import Schema, parse_schema


class Engine:
    """Holds indexes. An index is a DataFrame with a schema: what it reads is up to the DataFrame."""

    def __init__(self) -> None:
        self.indexes: dict[str, Index] = {}

    def create(self, name: str, docs: DataFrame, schema: Schema | str, id_col: str = "doc_id") -> Index:
        if name in self.indexes:
            raise QueryError(f"index {name!r} exists")
        self.indexes[name] = Index(docs, parse_schema(schema) if isinstance(schema, str) else schema, id_col)
        return self.indexes[name]

    def drop(self, name: str) -> None:
        self.indexes.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self.indexes)

    def __getitem__(self, name: str) -> Index:
        if name not in self.indexes:
            raise QueryError(f"no index {name!r}")
        return self.indexes[name]

    def node(self, index: Index, query: Mapping[str, Any] | str | N.Node, strict: bool = False) -> N.Node:
        if isinstance(query, N.Node):
            return query
        return router.route(index.schema, query, strict) if isinstance(query, str) else request.build(query)

    def search(
        self, name: str, query: Mapping[str, Any] | str | N.Node, limit: int = 10, offset: int = 0, fields_to_load: Sequence[str] = (),
        reranker: Mapping[str, Any] | None = None, l1: Mapping[str, Any] | None = None, strict: bool = False,
    ) -> DataFrame:
        """(id, score, loaded fields), best first.

        l1: {"formula": ..., "missing_values": {...}, "backfill": bool} ranks the candidates of
        a fusion; reranker: {"field", "vector", "limit", ...} orders the best anew.
        """
        index, (limit, offset) = self[name], request.page(limit, offset)
        node = self.node(index, query, strict)
        if isinstance(node, N.Fusion):
            if l1:
                hits = ranking.formula_rank(index, node, l1["formula"], l1.get("missing_values"), l1.get("backfill", True))
            else:
                hits = ranking.fuse(index, node)
        elif l1:
            raise QueryError("a formula ranks the branches of a fusion")
        else:
            hits = planner.hits(index, node)
        if reranker:
            f = index.schema[reranker["field"]]
            hits = ranking.rerank(
                hits, index.docs, f.name, list(reranker["vector"]), limit + offset, int(reranker.get("limit", 4 * (limit + offset))), index.id_col,
                request.combiner(reranker.get("combiner"), ranking.Combiner("max")), reranker.get("prefix"), reranker.get("rrf_k"), f.multi, reranker.get("bits"),
            )
        best = ranking.top_k(hits, limit, offset, index.id_col)
        return self.loaded(index, best, fields_to_load) if fields_to_load else best

    def loaded(self, index: Index, best: DataFrame, fields: Sequence[str]) -> DataFrame:
        """Hits with stored fields: at most a page of ids goes to the documents."""
        names = request.loaded(fields)
        if hidden := [f for f in names if not index.schema[f].stored]:
            raise QueryError(f"{hidden} are not stored")
        rows = index.docs.select(index.id_col, *[f for f in names if f != index.id_col])
        return rows.join(F.broadcast(best), index.id_col).orderBy(F.desc("score"), F.asc(index.id_col)).select(index.id_col, "score", *[f for f in names if f != index.id_col])

    def count(self, name: str, query: Mapping[str, Any] | str | N.Node) -> DataFrame:
        index = self[name]
        return planner.count(index, self.node(index, query))

    def document(self, name: str, doc_id: Any) -> DataFrame:
        index = self[name]
        return index.docs.filter(F.col(index.id_col) == doc_id)

    def collect(self, name: str, query: Mapping[str, Any] | str | N.Node, *aggregates) -> DataFrame:
        """Any aggregates over the hits (columns id and score), in the scan that finds them."""
        index = self[name]
        return planner.hits(index, self.node(index, query)).agg(*aggregates)

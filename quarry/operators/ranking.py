"""Ranked lists: the best k, fusion, formulas over features, reranking, windows of values."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions import scoring
from quarry.functions.formula import Formula
from quarry.functions.scoring import Combiner
from quarry.plans import nodes as N
from quarry.plans.nodes import QueryError
from quarry.plans.planner import Index, scored

#: Candidates of all branches together, and rows that a whole list may have to be ranked.
MOST_CANDIDATES = 200_000
#: Rows and queries of a block in which retrieval metrics compare vectors.
ROWS, ASKED = 8192, 512


def top_k(hits: DataFrame, limit: int = 10, offset: int = 0, id_col: str = "doc_id", score: str = "score") -> DataFrame:
    """Best scores first, ties by id; each task keeps limit + offset rows, so nothing else is shuffled."""
    if limit < 0 or offset < 0:
        raise QueryError("limit and offset are not negative")
    out = hits.orderBy(F.desc(score), F.asc(id_col)).limit(limit + offset)
    return out.offset(offset) if offset else out


def ranked(hits: DataFrame, depth: int, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The depth best hits with their rank from 1."""
    order = [F.desc("score"), *map(F.asc, keys)]
    best = hits.orderBy(*order).limit(depth)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def branch_scores(index: Index, branches: Sequence[N.Branch]) -> DataFrame:
    """Each branch's match and score of every document (b0_match, b0_score, ...), for several readers: one scan of the texts."""
    return scored(index, {f"b{i}": b.query for i, b in enumerate(branches)}, again=True)


def branch_lists(index: Index, fusion: N.Fusion, digits: int | None = None, rows: DataFrame | None = None, at: Sequence[int] | None = None) -> DataFrame:
    """(branch, id, ordinal, score, rank): each branch's nominations, from one scan.

    A branch of scope chunk nominates values by ordinal; others documents, as ordinal 0. ``rows``
    are branch_scores() that the caller has, and ``at`` the places there of the fusion's branches.
    """
    if fusion.depth * len(fusion.branches) > MOST_CANDIDATES:
        raise QueryError(f"a fusion has at most {MOST_CANDIDATES} candidates")
    rows = branch_scores(index, fusion.branches) if rows is None else rows
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    lists = []
    for j, b in enumerate(fusion.branches):
        i = at[j] if at else j
        mine = rows.filter(f"b{i}_match")
        if b.scope == "chunk":
            each = mine.select(index.id_col, F.posexplode(f"b{i}_ordinals").alias("ordinal", "score")).filter("score is not null")
        else:
            each = mine.select(index.id_col, F.lit(0).alias("ordinal"), F.col(f"b{i}_score").alias("score"))
        each = each.withColumn("score", rounded(F.col("score")))
        lists.append(ranked(each, fusion.depth, (index.id_col, "ordinal")).withColumn("branch", F.lit(j)))
    return functools.reduce(DataFrame.unionByName, lists)


def votes(lists: DataFrame, fusion: N.Fusion) -> DataFrame:
    """lists with vote: what each place in a list adds to its document or value."""
    weights = F.create_map(*[F.lit(x) for i, b in enumerate(fusion.branches) for x in (i, float(b.weight))])
    weight = F.element_at(weights, F.col("branch"))
    if fusion.method == "normalized_weighted_sum":
        w = Window.partitionBy("branch")
        low, high = F.min("score").over(w), F.max("score").over(w)
        scaled = F.when(high > low, (F.col("score") - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(1.0))
        return lists.withColumn("vote", weight * scaled)
    return lists.withColumn("vote", weight / (F.lit(float(fusion.k)) + F.col("rank")))


def fuse(index: Index, fusion: N.Fusion, digits: int | None = None) -> DataFrame:
    """(id, score): the fused list, in no order."""
    voted = votes(branch_lists(index, fusion, digits), fusion)
    each = voted.groupBy(index.id_col, "ordinal").agg(F.sum("vote").alias("vote"))
    per_doc = each.groupBy(index.id_col).agg(F.sort_array(F.collect_list(F.struct("ordinal", "vote"))).alias("v"))
    return per_doc.select(index.id_col, fusion.combiner.column(F.col("v.vote")).alias("score"))


def rrf_scores(index: Index, fusion: N.Fusion, digits: int | None = None) -> DataFrame:
    """(id, branch, ordinal, rank, contribution): where each vote of a reciprocal-rank fusion comes from."""
    voted = votes(branch_lists(index, fusion, digits), N.Fusion(fusion.branches, "rrf", fusion.k, fusion.depth))
    return voted.select(index.id_col, "branch", "ordinal", "rank", F.col("vote").alias("contribution"))


def candidates(index: Index, fusion: N.Fusion, backfill: bool = True, digits: int | None = None) -> DataFrame:
    """(id, a score by branch name, rrf): the features of all nominated documents, null where missing.

    With backfill a candidate has the scores of all branches that it matches, not only of those
    that nominated it. Branches that only score nominate nothing.
    """
    names = [b.name or f"b{i}" for i, b in enumerate(fusion.branches)]
    voting = [(i, b) for i, b in enumerate(fusion.branches) if not b.score_only]
    nominating = N.Fusion(tuple(b for _, b in voting), "rrf", fusion.k, fusion.depth)
    rows = branch_scores(index, fusion.branches) if backfill else None
    voted = votes(branch_lists(index, nominating, digits, rows, [i for i, _ in voting] if backfill else None), nominating)
    own = [F.max(F.when(F.col("branch") == j, F.col("score"))).alias(names[i]) for j, (i, _) in enumerate(voting)]
    nominated = voted.groupBy(index.id_col).agg(F.sum("vote").alias("rrf"), *own)
    if not backfill:
        return nominated.select(index.id_col, *[F.col(f"`{n}`") if n in nominated.columns else F.lit(None).cast("double").alias(n) for n in names], "rrf")
    each = [F.when(F.col(f"b{i}_match"), F.round(f"b{i}_score", digits) if digits is not None else F.col(f"b{i}_score")).alias(n) for i, n in enumerate(names)]
    # At most MOST_CANDIDATES ids, which branch_lists() checks.
    return rows.select(index.id_col, *each).join(F.broadcast(nominated.select(index.id_col, "rrf")), index.id_col)


def formula_rank(index: Index, fusion: N.Fusion, formula: str, missing: Mapping[str, float] | None = None, backfill: bool = True, digits: int | None = None) -> DataFrame:
    """(id, score): candidates by a formula over branch names and rrf."""
    rows = candidates(index, fusion, backfill, digits)
    names = [c for c in rows.columns if c != index.id_col]
    return rows.select(index.id_col, Formula(formula).column({n: F.col(f"`{n}`") for n in names}, missing).alias("score"))


def score_export(index: Index, fusion: N.Fusion, digits: int | None = None) -> DataFrame:
    """The raw features of every candidate, for a model elsewhere."""
    return candidates(index, fusion, True, digits)


def rerank(
    hits: DataFrame, docs: DataFrame, field: str, query: Sequence[float], limit: int, candidates: int, id_col: str = "doc_id",
    combiner: Combiner = Combiner("max"), prefix: int | None = None, rrf_k: float | None = None, multi: bool = False, bits: int | None = None, digits: int | None = None,
) -> DataFrame:
    """(id, score): the best candidates of a first ranking, ordered anew by their vectors.

    The score is the cosine (with bits: 1 - Hamming / bits). With prefix, only that many leading
    components choose 2 * limit documents first, if there are more. With rrf_k, places in both
    rankings are fused instead. Candidates without a vector drop out.
    """
    if candidates > MOST_CANDIDATES:
        raise QueryError(f"at most {MOST_CANDIDATES} candidates")
    first = ranked(hits.select(id_col, "score"), candidates, (id_col,)).select(id_col, F.col("rank").alias("rank_1"))
    # No more than MOST_CANDIDATES rows are sent.
    rows = docs.select(id_col, F.col(field).alias("v")).filter("v is not null").join(F.broadcast(first), id_col)

    def by(n: int | None) -> Column:
        one = (lambda v: scoring.hamming_similarity(v, query, bits)) if bits else (lambda v: scoring.cosine(F.slice(v, 1, n) if n else v, query[:n] if n else query))
        score = combiner.column(F.transform("v", one)) if multi else one(F.col("v"))
        return F.round(score, digits) if digits is not None else score

    if prefix:
        rows = top_k(rows.withColumn("score", by(prefix)), 2 * limit, 0, id_col).drop("score")
    out = rows.withColumn("score", by(None))
    if rrf_k is not None:
        second = out.withColumn("rank_2", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc(id_col))))
        out = second.withColumn("score", 1 / (F.lit(float(rrf_k)) + F.col("rank_1")) + 1 / (F.lit(float(rrf_k)) + F.col("rank_2")))
    return top_k(out.select(id_col, "score"), limit, 0, id_col)


def ordinal_window(values: Column, scores: Column, top: int = 1, radius: int = 1) -> Column:
    """The values within radius of the top best-scored ones, in order; ties go to the lower ordinal."""
    if not (1 <= top <= 64 and 0 <= radius <= 16):
        raise QueryError("top goes from 1 to 64 and radius from 0 to 16")
    placed = F.filter(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))), lambda x: x["s"].isNotNull())
    best = F.slice(F.array_sort(placed), 1, top)
    near = lambda best: F.filter(values, lambda v, i: F.exists(best, lambda b: F.abs(b["i"] - i) <= radius))
    return F.transform(F.array(best), near)[0]  # bound once: no value sorts the scores anew


def relevance(vectors: DataFrame, queries: Column, id_col: str, vector_col: str, label_col: str, ks: Sequence[int] = (1, 10)) -> DataFrame:
    """One row of retrieval metrics: query rows search all other rows; equal labels are relevant.

    For each query the rank is that of its best relevant row; other rows that tie with it count
    against it. Gives n_queries, top1, mrr, recall@k for each k and ndcg@10.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("q")).filter("v is not null")
    n, n_asked = rows.agg(F.count("*"), F.count_if("q")).first()
    # A stated set of queries against all rows, a block of either at a time; what is kept of a block is a number for each query.
    dealt = lambda c, size, total: F.pmod(F.xxhash64(c), F.lit(max(1, -(-total // size)))).cast("int")
    each = lambda size, total: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-total // size)) - 1)))
    against = rows.select("id", "label", "v", dealt("id", ROWS, n).alias("part"), each(ASKED, n_asked).alias("block"))
    asked = rows.filter("q").select(F.col("id").alias("qid"), F.col("label").alias("ql"), F.col("v").alias("qv"), dealt("id", ASKED, n_asked).alias("block"))
    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("qid", "ql")}

    def scores(v: pa.Table, q: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, rows): cosines, which rows are relevant, which are the query itself."""
        x, y = (np.array(t[c].to_pylist(), float).reshape(len(t), -1) for t, c in ((q, "qv"), (v, "v")))
        with np.errstate(invalid="ignore", divide="ignore"):
            s = (x @ y.T / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1)))).round(6)
        same = lambda a, b: q[a].to_numpy(zero_copy_only=False)[:, None] == v[b].to_numpy(zero_copy_only=False)
        return s, same("ql", "label"), same("qid", "id")

    def best_of(v: pa.Table, q: pa.Table) -> pa.Table:
        if not len(v) or not len(q):
            return pa.table({"qid": q["qid"].slice(0, 0), "best": pa.array([], pa.float64())})
        s, relevant, own = scores(v, q)
        best = np.where(relevant & ~own, s, -np.inf).max(axis=1)
        return pa.table({"qid": q["qid"], "best": pa.array(best)}).filter(pa.array(best > -np.inf))

    def above(v: pa.Table, q: pa.Table) -> pa.Table:
        if not len(v) or not len(q):
            return pa.table({"qid": q["qid"].slice(0, 0), "above": pa.array([], pa.int64())})
        s, relevant, own = scores(v, q)
        return pa.table({"qid": q["qid"], "above": pa.array((~relevant & ~own & (s >= q["best"].to_numpy()[:, None])).sum(axis=1))})

    def in_blocks(q: DataFrame, f, schema: str) -> DataFrame:
        return against.groupBy("part", "block").cogroup(q.withColumn("part", each(ROWS, n)).groupBy("part", "block")).applyInArrow(f, schema)

    best = in_blocks(asked, best_of, f"qid {kinds['qid']}, best double").groupBy("qid").agg(F.max("best").alias("best"))
    rank = in_blocks(asked.join(best, "qid").select("qid", "ql", "qv", "block", "best"), above, f"qid {kinds['qid']}, above long").groupBy("qid").agg((F.sum("above") + 1).alias("rank"))
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return rank.agg(
        F.count("*").alias("n_queries"), hit(1).alias("top1"), F.avg(1 / F.col("rank")).alias("mrr"), *[hit(k).alias(f"recall_{k}") for k in ks],
        F.avg(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("ndcg_10"),
    )


__all__ = [x for x in dir() if not x.startswith("_") and x not in ("annotations", "operator")]

"""Exact top-k inner-product search with a KD-tree in each shard of the vectors.

Shards are cells of a KD-tree over the whole table, so that vectors of a shard lie together
and its bounding box is tight. A query searches its own shard first; its kth score there goes
with it, and it visits only those other shards whose box can hold a score that high.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import cut, importable

#: Vectors of a shard, of a leaf, queries that go through a shard together, and boxes that they are held against together.
SHARD, LEAF, QUERIES, BOXES = 8192, 64, 2048, 4096
#: About how many vectors of one length are drawn to place the shards' borders; every vector is then dealt by them.
SAMPLE = 16_384
_LIMIT = 2**63 - 1


class Tree:
    """Median splits along the widest side; every node has its points' tight bounding box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order, self.opened = np.arange(len(points)), 0  # opened: leaves that searches looked into
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        low, high = [], []
        todo = [(0, len(points), -1, 0)] if len(points) else []
        while todo:
            a, z, parent, side = todo.pop()
            part = points[self.order[a:z]]
            me = len(self.spans)
            low.append(part.min(axis=0)), high.append(part.max(axis=0))
            self.spans.append((a, z))
            self.children.append(None)
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = me
                self.children[parent] = tuple(pair)
            widths = high[-1] - low[-1]
            if z - a > leaf and widths.size and widths.max() > 0:
                middle = (z - a) // 2
                self.order[a:z] = self.order[a:z][np.argpartition(part[:, int(widths.argmax())], middle)]
                self.children[me] = (-1, -1)
                todo += [(a, a + middle, me, 0), (a + middle, z, me, 1)]
        self.low, self.high = np.array(low), np.array(high)
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product that each query can have in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, id) of at least least, the query's own row left out.

        Best-first: the box of highest bound is opened next. A box is left closed only if its
        bound is below the kth score so far (or below least, the kth score of another shard), so
        that ties are all seen.
        """
        best: list[tuple[float, int]] = []
        heap = [(-bounds[0], 0)] if len(bounds) else []
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            if pair := self.children[node]:
                for child in pair:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, z = self.spans[node]
            self.opened += 1
            scores = self.points[a:z] @ query
            for i in np.flatnonzero(scores >= least).tolist():
                at = self.order[a + i]
                if rows[at] != own:
                    item = (scores[i], -ids[at])
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            if len(best) == k:
                least = max(least, best[0][0])
        return [(int(s), int(-i)) for s, i in sorted(best, reverse=True)]


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0), np.int64)


class Borders:
    """A KD-tree's splits, drawn from a sample, that deal vectors to so many cells."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.splits: list[tuple[int, float, int, int]] = []  # axis, border, and where each side goes on (~cell at the end)
        self.cells = 0
        self.top = self._split(sample, cells)

    def _split(self, part: np.ndarray, cells: int) -> int:
        if cells <= 1 or len(part) < 2 or not (width := part.max(axis=0) - part.min(axis=0)).max() > 0:
            self.cells += 1
            return ~(self.cells - 1)
        axis, me = int(width.argmax()), len(self.splits)
        values = np.sort(part[:, axis])
        border = values[min(len(values) - 1, len(values) * (cells // 2) // cells)]
        if border == values[0]:  # the low side would be empty
            border = values[np.searchsorted(values, border, "right")]
        self.splits.append((axis, float(border), 0, 0))
        low = part[:, axis] < border
        self.splits[me] = (axis, float(border), self._split(part[low], cells // 2), self._split(part[~low], cells - cells // 2))
        return me

    def place(self, points: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out, todo = np.zeros(len(points), np.int32), [(self.top, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            axis, border, left, right = self.splits[node]
            low = points[rows, axis] < border
            todo += [(left, rows[low]), (right, rows[~low])]
        return out


def _exact(*matrices: np.ndarray) -> bool:
    """Whether inner products of the two matrices' rows are exact in float64."""
    high = [float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0 for x in matrices]
    return high[0] * high[1] * max(1, matrices[0].shape[1]) < 2**52


def _search_all(vectors: pa.Table, queries: pa.Table, k: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(row, id, results) of each query in one shard."""
    nv, nq = len(vectors), len(queries)
    if not nv or not nq:
        return []
    v, q = _matrix(vectors["v"], nv), _matrix(queries["v"], nq)
    ids, rows = vectors["vec_id"].to_numpy(), vectors["row"].to_numpy()
    least = [-np.inf if x is None else x for x in queries["least"].to_pylist()]
    out = []
    if _exact(v, q):
        v, q = v.astype(np.float64), q.astype(np.float64)
        tree = Tree(v)
        bounds = tree.bounds(q)
        for i, (row, name) in enumerate(zip(queries["row"].to_pylist(), queries["vec_id"].to_pylist())):
            out.append((row, name, tree.search(q[i], bounds[i], ids, rows, row, k, least[i])))
        return out
    v, q = v.astype(object), q.astype(object)  # components too large for that: plain integers, every vector
    for i, (row, name) in enumerate(zip(queries["row"].to_pylist(), queries["vec_id"].to_pylist())):
        scores = [max(-_LIMIT, min(_LIMIT, x)) for x in v @ q[i]]
        ranked = sorted((-s, n) for s, n, r in zip(scores, ids.tolist(), rows.tolist()) if r != row)
        out.append((row, name, [(-s, n) for s, n in ranked[:k]]))
    return out


def reachable(queries: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, boxes): whether a box can hold a score of at least a query's least."""
    if not (_exact(queries, low) and _exact(queries, high)):
        return np.ones((len(queries), len(low)), bool)
    q = queries.astype(np.float64)
    return np.maximum(q, 0) @ high.astype(np.float64).T + np.minimum(q, 0) @ low.astype(np.float64).T >= least[:, None]


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as double; null if the vector can't take part."""
    inf = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < inf))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shard: int = SHARD, block: int = QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest integer inner products.

    is_query is a condition on the rows of vectors. Every other row is a candidate; ties go to
    the smaller vec_id. Rows are dealt to shards of about ``shard`` vectors by the borders of a
    KD-tree, which a bounded sample (SAMPLE) places; a cell that still holds more, such as many
    equal vectors, is dealt to several shards. A query first searches its own shard; then, blocks
    of queries at a time, the shards whose box bound reaches its kth score there.

    Rows with a null id or a vector that is null or holds null, NaN or infinite components take
    no part. Vectors of unlike length are not compared. Fewer than k candidates give fewer
    results. Rows that repeat an id are rows of their own: other rows' candidates, and queries of
    their own. Components beyond 64 bits are held at that range's ends, and so are scores. An
    empty table gives no rows; other columns are not looked at.
    """
    importable(vectors.sparkSession)
    taken = vectors.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("is_query"), quantised(F.col(vector_col), scale).alias("v")).filter("vec_id is not null and v is not null")
    large = {r["d"]: r["count"] for r in taken.groupBy(F.size("v").alias("d")).count().filter(F.col("count") > shard).collect()}  # a row for each shard at most
    borders = {}
    for d, n in large.items():
        drawn = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1_000_000)) < int(1e6 * min(1.0, SAMPLE / n))
        sample = np.array([r["v"] for r in taken.filter((F.size("v") == d) & drawn).select("v").collect()], np.int64)
        borders[d] = Borders(sample, -(-n // shard)) if len(sample) else None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, cell = pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False), np.zeros(b.num_rows, np.int32)
            for d in np.unique(sizes).tolist():
                if borders.get(d):
                    at = np.flatnonzero(sizes == d)
                    cell[at] = borders[d].place(_matrix(b.column(2).take(pa.array(at)), len(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int32()), pa.array(cell)], ["vec_id", "is_query", "v", "d", "cell"])

    rows = cut(taken.mapInArrow(deal, "vec_id long, is_query boolean, v array<long>, d int, cell int").withColumn("row", F.monotonically_increasing_id()), "vectors")
    unit = ["d", "cell", "part"]
    parts = rows.groupBy("d", "cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    placed = rows.join(parts, ["d", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    results = ["row", "query_id", "vec_id", "score"]

    def own(t: pa.Table) -> pa.Table:
        """The shard's box, and its own queries' results there with their kth score."""
        at = {c: t[c][0].as_py() for c in unit}
        v = _matrix(t["v"], len(t))
        asked = t.filter(t["is_query"])
        asked = asked.append_column("least", pa.nulls(len(asked), pa.int64()))
        flat = [(row, name, i, s, found[-1][0] if len(found) == k else None) for row, name, found in _search_all(t, asked, k) for s, i in found]
        n = len(flat) + 1
        out = {c: pa.array([x] * n, pa.int32()) for c, x in at.items()}
        out |= {c: pa.array([None, *(x[j] for x in flat)], pa.int64()) for j, c in enumerate([*results, "least"])}
        out |= {c: pa.array([x.tolist(), *[None] * len(flat)], pa.list_(pa.int64())) for c, x in (("low", v.min(axis=0)), ("high", v.max(axis=0)))}
        return pa.table(out)

    first = placed.select(*unit, "row", "vec_id", "is_query", "v").groupBy(*unit).applyInArrow(own, "d int, cell int, part int, row long, query_id long, vec_id long, score long, least long, low array<long>, high array<long>")
    first = cut(first, "first")
    boxes, home = first.filter("row is null").select(*unit, "low", "high"), first.filter("row is not null")
    queries = placed.filter("is_query").join(home.groupBy("row").agg(F.min("least").alias("least")), "row", "left").select(*unit, "row", "vec_id", "v", "least")
    n_boxes, n_queries = boxes.count(), rows.filter("is_query").count()
    dealt = lambda c, n: F.pmod(F.xxhash64(*c), F.lit(max(1, n))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n)) - 1))
    nb, nq = -(-n_boxes // BOXES), -(-n_queries // block)

    def route(q: pa.Table, b: pa.Table) -> pa.Table:
        """(row, unit) of each query and each other shard that can better its kth score."""
        empty = pa.table({c: pa.array([], t) for c, t in (("row", pa.int64()), *((c, pa.int32()) for c in unit))})
        if not len(q) or not len(b):
            return empty
        least = np.array([-np.inf if x is None else x for x in q["least"].to_pylist()])
        low, high = (_matrix(b[c], len(b)) for c in ("low", "high"))
        ok = reachable(_matrix(q["v"], len(q)), least, low, high)
        for c in unit[1:]:
            theirs = b[c].to_numpy()
            ok_home = q[c].to_numpy()[:, None] == theirs if c == unit[1] else ok_home & (q[c].to_numpy()[:, None] == theirs)
        i, j = np.nonzero(ok & ~ok_home)
        return pa.table({"row": q["row"].take(pa.array(i)), **{c: b[c].take(pa.array(j)) for c in unit}})

    names = [*queries.columns, "bq", "bb"]
    asked = queries.withColumn("bq", dealt(["row"], nq)).withColumn("bb", each(nb)).toDF(*names).groupBy("d", "bq", "bb")
    against = boxes.withColumn("bb", dealt(unit, nb)).withColumn("bq", each(nq)).groupBy("d", "bq", "bb")
    routed = cut(asked.cogroup(against).applyInArrow(route, "row long, d int, cell int, part int"), "routed")
    blocks = routed.groupBy(*unit).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    visits = routed.join(blocks, unit).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).join(queries.select("row", "vec_id", "v", "least"), "row")
    visited = placed.join(blocks, unit).select(*unit, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "row", "vec_id", "v")

    def every(v: pa.Table, q: pa.Table) -> pa.Table:
        flat = [(row, name, i, s) for row, name, found in _search_all(v, q, k) for s, i in found]
        return pa.table({c: pa.array([x[j] for x in flat], pa.int64()) for j, c in enumerate(results)})

    keys = [*unit, "block"]
    renewed = lambda t, *more: t.select(*keys, "row", "vec_id", "v", *more).toDF(*keys, "row", "vec_id", "v", *more)  # noqa: E731  both sides come from one table
    found = renewed(visited).groupBy(*keys).cogroup(renewed(visits, "least").groupBy(*keys)).applyInArrow(every, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.unionByName(home.select(*results)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""From logical queries to DataFrames.

A query becomes two columns of a document's row: whether it matches, and its score. So a
search is one scan with filters and projections, and its top k needs no shuffle but that of k
rows a task. What scores need of the whole index (counts, lengths, document frequencies) is one
aggregate, whose single row enters the plan as literals. Both read the same facts, what a text
says about the query's words (counts, lengths, places): where statistics are missing, or several
readers want the scores, the scan that tokenises the texts writes the facts, a few numbers a
document, and nothing tokenises them again.
"""

from __future__ import annotations

import functools
import operator
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import scoring
from quarry.functions.analysis import Analyzer, analyzer
from quarry.operators.written import materialised
from quarry.plans import nodes as N, patterns
from quarry.plans.nodes import QueryError
from quarry.schema import Field, Schema

#: Clauses of a SHOULD group that stay; of more text terms the rarest.
MOST_SHOULD = 64


@dataclass(frozen=True)
class Compiled:
    match: Column
    score: Column
    constant: bool = False
    by_ordinal: Column | None = None  # array<double>, null where the value doesn't match


def _any(columns: list[Column]) -> Column:
    return functools.reduce(operator.or_, columns) if columns else F.lit(False)


def _all(columns: list[Column]) -> Column:
    return functools.reduce(operator.and_, columns) if columns else F.lit(True)


@dataclass(frozen=True)
class Stats:
    """n: documents, of a chunked field chunks; holders: those that have the field."""

    n: int
    holders: int
    tokens: int
    floor: int  # least length that a chunk counts as
    df: dict[str, int]

    @property
    def average(self) -> float:
        return self.tokens / self.holders if self.holders else 0.0

    def idf(self, token: str) -> float:
        return scoring.idf(self.n, self.df.get(token, 0))


class Index:
    """Documents with a schema. id_col names a unique, sortable column."""

    def __init__(self, docs: DataFrame, schema: Schema, id_col: str = "doc_id", stats: dict[str, Stats] | None = None) -> None:
        self.docs, self.schema, self.id_col = docs, schema, id_col
        self.known = dict(stats or {})

    def analyzer(self, name: str) -> Analyzer:
        return analyzer(self.schema[name].tokenizer)

    def tokens(self, name: str) -> Column:
        """A text field's tokens: array<string>, of a chunked field an array of those."""
        f, a = self.schema[name], self.analyzer(name)
        if not f.multi:
            return a.column(F.col(name))
        if f.chunked:
            return F.transform(F.col(name), lambda c: a.column(c))
        return F.flatten(F.transform(F.col(name), lambda c: a.column(c)))

    def text_field(self, name: str) -> Field:
        f = self.schema[name]
        if f.kind != "text" or not f.indexed:
            raise QueryError(f"{name!r} is no indexed text field")
        return f

    def missing(self, wanted: dict[str, set[str]]) -> dict[str, set[str]]:
        """Of wanted, the fields and tokens whose statistics are not known."""
        new = {f: terms - set(self.known[f].df) if f in self.known else terms for f, terms in wanted.items()}
        return {f: terms for f, terms in new.items() if terms or f not in self.known}

    def gather(self, wanted: dict[str, set[str]]) -> None:
        """One pass over the documents for the statistics of fields, and the df of tokens."""
        if missing := self.missing(wanted):
            plan = Planner(self, missing)
            self.learn(missing, plan, plan.facts())

    def learn(self, missing: dict[str, set[str]], plan: Planner, facts: DataFrame) -> None:
        """Statistics from the facts that plan has written."""
        out = []
        for f, terms in missing.items():
            names = sorted(terms)
            if self.schema[f].chunked:
                present = F.filter(plan.chunks(f), lambda x: x.isNotNull())
                out += [F.coalesce(F.sum(F.size(present)), F.lit(0)), F.coalesce(F.sum(F.aggregate(present, F.lit(0), lambda s, x: s + x["l"])), F.lit(0))]
                out += [F.coalesce(F.sum(F.size(F.filter(present, lambda x: x[plan.slot(f, t)] > 0))), F.lit(0)) for t in names]  # noqa: B023
            else:
                length = plan.length(f)
                out += [F.count(length), F.coalesce(F.sum(length), F.lit(0))]
                out += [F.count_if(plan.term_parts(f, t)[0] > 0) for t in names]
        got = facts.agg(F.count("*").alias("n"), *[x.alias(f"s{i}") for i, x in enumerate(out)]).first()
        at = 1
        for f, terms in missing.items():
            holders, tokens = int(got[at]), int(got[at + 1])
            df = dict(zip(sorted(terms), map(int, got[at + 2 : at + 2 + len(terms)])))
            at += 2 + len(terms)
            chunked, old = self.schema[f].chunked, self.known.get(f)
            floor = old.floor if old else self.chunk_floor(facts, plan.chunks(f)) if chunked else 0
            self.known[f] = Stats(holders if chunked else int(got["n"]), holders, tokens, floor, (old.df if old else {}) | df)

    def chunk_floor(self, facts: DataFrame, chunks: Column) -> int:
        """The least length that nine of ten chunks don't exceed."""
        lengths = facts.select(F.explode(F.transform(chunks, lambda x: x["l"])).alias("x"))
        return int(lengths.agg(F.expr("percentile_disc(0.9) within group (order by x)")).first()[0] or 0)


class Planner:
    """wanted: fields, and those of their tokens that the queries name.

    Features depend on a document and the queries alone, never on statistics. While it learns
    which there are, statistics are stubs, and every token and clause counts as chosen.
    """

    def __init__(self, index: Index, wanted: dict[str, set[str]] | None = None) -> None:
        self.index, self.schema = index, index.schema
        self.features: dict[str, tuple[str, Column]] = {}
        self.token_columns: dict[str, str] = {}
        self.terms = {f: sorted(t) for f, t in (wanted or {}).items()}
        self.used: dict[str, None] = {}
        self.written: DataFrame | None = None
        self.learning = False

    # Columns that several clauses use stand once in the plan

    def tok(self, name: str) -> Column:
        self.index.text_field(name)
        return F.col(self.token_columns.setdefault(name, f"__tokens_{len(self.token_columns)}"))

    def feature(self, key: str, make: Callable[[], Column]) -> Column:
        if key not in self.features:
            if self.written is not None:
                raise AssertionError(f"{key} is not among the facts that were written")
            column = make()
            self.features[key] = f"__feature_{len(self.features)}", column
        return F.col(self.features[key][0])

    def column(self, name: str) -> Column:
        """A field's own column, which facts then hold."""
        self.used[name] = None
        return F.col(name)

    def stats(self, name: str) -> Stats:
        return Stats(0, 0, 0, 0, {}) if self.learning else self.index.known[name]

    def analysed(self, name: str, text: str) -> list[tuple[int, str]]:
        self.index.text_field(name)
        return [(i, t) for i, t in enumerate(self.index.analyzer(name).local(text)) if t is not None]

    def wanted(self, node: N.Node) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for x in N.walk(node):
            if isinstance(x, (N.Term, N.Match, N.Phrase)) and not self.compared_whole(x):
                out.setdefault(x.field, set()).update(t for _, t in self.analysed(x.field, x.text))
        return out

    # Text

    def compared_whole(self, node: N.Node) -> bool:
        f = self.schema[node.field]
        return isinstance(node, N.Term) and f.kind == "text" and f.fast and not f.indexed

    def length(self, name: str) -> Column:
        """Tokens of a plain text field; null without a text."""
        return self.feature(f"len:{name}", lambda: (lambda t: F.when(t.isNotNull(), F.size(F.array_compact(t))))(self.tok(name)))

    def term_parts(self, name: str, token: str) -> tuple[Column, Column]:
        """(tf, length) of a plain text field."""
        count = lambda t: F.coalesce(F.size(t) - F.size(F.array_remove(t, token)), F.lit(0))
        return self.feature(f"tf:{name}:{token}", lambda: count(self.tok(name))), self.length(name)

    def slot(self, name: str, token: str) -> str:
        """The field of chunks() that counts a token."""
        return f"t{self.terms[name].index(token)}"

    def chunks(self, name: str) -> Column:
        """Of each chunk its length and how often it has each wanted token; null for a null chunk."""
        tf = lambda c, t: F.size(c) - F.size(F.array_remove(c, t))
        one = lambda c: F.when(c.isNotNull(), F.struct(F.size(F.array_compact(c)).alias("l"), *[tf(c, t).alias(self.slot(name, t)) for t in self.terms[name]]))
        return self.feature(f"chunks:{name}", lambda: F.transform(self.tok(name), one))

    def weigh(self, name: str, tf: Column, length: Column, idf: float, boost: float = 1.0) -> Column:
        f, s = self.schema[name], self.stats(name)
        if f.chunked:
            length = F.greatest(length, F.lit(s.floor))
        return scoring.bm25(tf, length, idf, s.average, f.k1, f.b, boost)

    def folded(self, scores: Column) -> Compiled:
        """A chunked field's scores by chunk -> the document's: the best chunk counts."""
        best = F.array_max(scores)
        return Compiled(best.isNotNull(), F.coalesce(best, F.lit(0.0)), by_ordinal=scores)

    def bag(self, name: str, tokens: list[tuple[str, int]], need_all: bool, boost: float = 1.0) -> Compiled:
        """A document's (or best chunk's) sum over tokens with their counts in the query."""
        stats = self.stats(name)
        if not self.schema[name].chunked:
            parts = [(self.term_parts(name, t), n * stats.idf(t)) for t, n in tokens]
            matches = [tf > 0 for (tf, _), _ in parts]
            match = _all(matches) if need_all else _any(matches)
            total = functools.reduce(operator.add, [self.weigh(name, tf, length, idf, boost) for (tf, length), idf in parts]) if parts else F.lit(0.0)
            return Compiled(match, F.when(match, total).otherwise(F.lit(0.0)))

        def chunk(c: Column) -> Column:
            tfs = [c[self.slot(name, t)] for t, _ in tokens]
            total = functools.reduce(operator.add, [self.weigh(name, tf, c["l"], n * stats.idf(t), boost) for tf, (t, n) in zip(tfs, tokens)])
            matches = [tf > 0 for tf in tfs]
            return F.when(_all(matches) if need_all else _any(matches), total)

        return self.folded(F.transform(self.chunks(name), chunk))

    def term(self, node: N.Term) -> Compiled:
        if self.compared_whole(node):
            value = self.column(node.field)
            hit = F.coalesce(F.array_contains(value, node.text) if self.schema[node.field].multi else value == F.lit(node.text), F.lit(False))
            return Compiled(hit, F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0)), True)
        tokens = [t for _, t in self.analysed(node.field, node.text)]
        if not tokens:
            raise QueryError(f"{node.text!r} has no token in {node.field!r}")
        return self.bag(node.field, [(t, 1) for t in dict.fromkeys(tokens)], True, node.field_boost)

    def match(self, node: N.Match) -> Compiled:
        tokens = [t for _, t in self.analysed(node.field, node.text)]
        counts = list(Counter(tokens).items())
        df = self.stats(node.field).df if counts else {}
        most = self.schema[node.field].max_terms if node.max_terms is None else node.max_terms
        if len(counts) > most and not self.learning:  # the rarest stay; those that no document has rank last
            rank = sorted(range(len(counts)), key=lambda i: (df.get(counts[i][0], 0) == 0, df.get(counts[i][0], 0), i))[:most]
            counts = [counts[i] for i in sorted(rank)]
        if not counts:
            return Compiled(F.lit(False), F.lit(0.0))
        out = self.bag(node.field, counts, False, node.field_boost)
        if node.proximity_weight and len(tokens) > 1:
            if self.schema[node.field].chunked:
                raise QueryError("proximity is for plain text fields")
            return Compiled(out.match, F.when(out.match, out.score + F.lit(float(node.proximity_weight)) * self.proximity(node, [t for t, _ in counts])).otherwise(F.lit(0.0)))
        return out

    def proximity(self, node: N.Match, tokens: list[str]) -> Column:
        """For each two neighbouring query words, BM25 of how often they stand in order, and half that of how often near."""
        stats, bonus = self.stats(node.field), [F.lit(0.0)]
        places = lambda w: lambda: F.filter(F.transform(self.tok(node.field), lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
        _, length = self.term_parts(node.field, tokens[0])
        for a, b in zip(tokens, tokens[1:]):
            pa, pb = self.feature(f"at:{node.field}:{a}", places(a)), self.feature(f"at:{node.field}:{b}", places(b))
            near = lambda test: F.coalesce(F.aggregate(pa, F.lit(0), lambda s, i: s + F.size(F.filter(pb, lambda j: test(i, j)))), F.lit(0))
            ordered, unordered = near(lambda i, j: j == i + 1), near(lambda i, j: F.abs(j - i) <= node.proximity_window)
            mean = (stats.idf(a) + stats.idf(b)) / 2
            bonus += [self.weigh(node.field, ordered, length, mean), F.lit(0.5) * self.weigh(node.field, unordered, length, mean)]
        return functools.reduce(operator.add, bonus)

    def phrase(self, node: N.Phrase) -> Compiled:
        tokens = self.analysed(node.field, node.text)
        f = self.schema[node.field]
        if not tokens:
            raise QueryError(f"{node.text!r} has no token in {node.field!r}")
        if len(tokens) == 1:
            return self.bag(node.field, [(tokens[0][1], 1)], True)
        if not f.has_token_positions:
            raise QueryError(f"a phrase needs token positions, which {node.field!r} has not")
        first, idf = tokens[0][0], sum(self.stats(node.field).idf(t) for _, t in tokens)

        def frequency(c: Column) -> Column:
            """How often the phrase stands in the tokens c: c is bound once, so that no lambda computes it anew."""

            def starts(body: Column, i: Column) -> Column:
                near = lambda d, t: _any([F.get(body, i + (d + s)) == t for s in range(-node.slop, node.slop + 1)])
                return F.coalesce(_all([near(p - first, t) for p, t in tokens[1:]]), F.lit(False))

            def within(body: Column) -> Column:
                places = F.filter(F.transform(body, lambda x, i: F.when(x == tokens[0][1], i)), lambda i: i.isNotNull())
                return F.size(F.filter(places, lambda i: starts(body, i)))

            holds = lambda body: _all([F.array_contains(body, t) for t in dict.fromkeys(t for _, t in tokens)])
            return F.transform(F.array(c), lambda body: F.when(holds(body), within(body)).otherwise(F.lit(0)))[0]

        if f.chunked:
            tfs = self.feature(f"phrase:{node}", lambda: F.transform(self.tok(node.field), frequency))
            return self.folded(F.zip_with(tfs, self.chunks(node.field), lambda tf, c: F.when(tf > 0, self.weigh(node.field, tf, c["l"], idf))))
        tf = self.feature(f"phrase:{node}", lambda: F.coalesce(frequency(self.tok(node.field)), F.lit(0)))
        _, length = self.term_parts(node.field, tokens[0][1])
        return Compiled(tf > 0, self.weigh(node.field, tf, length, idf))

    def pattern(self, node: N.Node) -> Compiled:
        if self.index.text_field(node.field).chunked:
            raise QueryError(f"patterns are for plain text fields; {node.field!r} is chunked")
        if isinstance(node, N.Prefix):
            test = lambda t: t.startswith(node.prefix.lower())
        elif isinstance(node, N.Wildcard):
            java = patterns.wildcard(node.pattern.lower())
            test = lambda t: t.rlike(java)
        else:
            java = patterns.regex(node.pattern)
            test = lambda t: t.rlike(java)
        hit = self.feature(f"pattern:{node}", lambda: F.coalesce(F.exists(self.tok(node.field), lambda t: F.coalesce(test(t), F.lit(False))), F.lit(False)))
        return Compiled(hit, hit.cast("double"), True)

    # Other leaves

    def range(self, node: N.Range) -> Compiled:
        f = self.schema[node.field]
        if not f.fast:
            raise QueryError(f"a range needs a fast field, which {node.field!r} is not")
        value = F.get(self.column(node.field), 0) if f.multi else self.column(node.field)
        tests = [value.isNotNull()] + [value >= F.lit(node.low)] * (node.low is not None) + [value <= F.lit(node.high)] * (node.high is not None)
        hit = _all(tests)
        return Compiled(hit, F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0)), True)

    def vector(self, node: N.Node) -> Compiled:
        f, column = self.schema[node.field], F.col(node.field)
        if isinstance(node, N.Sparse):
            if f.kind != "sparse_vector":
                raise QueryError(f"{node.field!r} holds no sparse vectors")
            query: dict[int, float] = {}
            for d, w in node.entries:
                query[d] = query.get(d, 0.0) + w
            shares = lambda v: F.exists(v, lambda e: e["dim"].isin(sorted(query))) if query else F.lit(False)
            score = lambda v: F.when(shares(v), scoring.sparse_dot(v, query))
        elif isinstance(node, N.Dense):
            if f.kind != "dense_vector" or f.dims and f.dims != len(node.vector):
                raise QueryError(f"{node.field!r} holds no dense vectors of {len(node.vector)} components")
            score = lambda v: F.when(v.isNotNull(), scoring.cosine(v, node.vector))
        else:
            if f.kind != "binary_dense_vector" or f.dims and f.dims != node.bits:
                raise QueryError(f"{node.field!r} holds no codes of {node.bits} bits")
            score = lambda v: F.when(v.isNotNull(), scoring.hamming_similarity(v, node.words, node.bits))
        if f.multi:
            each = self.feature(f"vector:{node}", lambda: F.transform(column, score))
            matched = F.filter(each, lambda s: s.isNotNull())
            hit = F.coalesce(F.size(matched) > 0, F.lit(False))
            return Compiled(hit, F.when(hit, node.combiner.column(matched)).otherwise(F.lit(0.0)), by_ordinal=each)
        one = self.feature(f"vector:{node}", lambda: score(column))
        return Compiled(one.isNotNull(), F.coalesce(one, F.lit(0.0)), by_ordinal=F.array(one))

    # Composition

    def boolean(self, node: N.Boolean) -> Compiled:
        should = list(node.should)
        if len(should) > MOST_SHOULD and not self.learning:
            df = {i: min(self.stats(x.field).df.get(t, 0) for _, t in self.analysed(x.field, x.text)) for i, x in enumerate(should) if isinstance(x, N.Term) and not self.compared_whole(x)}
            order = sorted(range(len(should)), key=lambda i: (df.get(i, 0) == 0, df.get(i, 0), i)) if len(df) == len(should) else range(len(should))
            should = [should[i] for i in sorted(list(order)[:MOST_SHOULD])]
        must, some, none = ([self.compile(x) for x in clauses] for clauses in (node.must, should, node.must_not))
        if not (must or some or none):
            return Compiled(F.lit(False), F.lit(0.0))
        match = _all([x.match for x in must]) if must or not some else _any([x.match for x in some])
        match = _all([match] + [~x.match for x in none])
        # A filter among what must match has no score beside clauses that may match; alone it has its own.
        scored = [x.score for x in must if not (x.constant and some)] + [x.score for x in some]
        total = functools.reduce(operator.add, scored) if scored else F.lit(0.0)
        return Compiled(match, F.when(match, total).otherwise(F.lit(0.0)))

    def compile(self, node: N.Node) -> Compiled:
        if isinstance(node, N.All):
            return Compiled(F.lit(True), F.lit(1.0), True)
        if isinstance(node, N.Term):
            return self.term(node)
        if isinstance(node, N.Match):
            return self.match(node)
        if isinstance(node, N.Phrase):
            return self.phrase(node)
        if isinstance(node, (N.Prefix, N.Wildcard, N.Regex)):
            return self.pattern(node)
        if isinstance(node, N.Range):
            return self.range(node)
        if isinstance(node, (N.Sparse, N.Dense, N.Binary)):
            return self.vector(node)
        if isinstance(node, N.Boolean):
            return self.boolean(node)
        if isinstance(node, N.Boost):
            inner = self.compile(node.query)
            return Compiled(inner.match, inner.score * F.lit(float(node.factor)), inner.constant)
        if isinstance(node, N.Filtered):
            inner, filters = self.compile(node.query), [self.compile(x).match for x in node.filters]
            match = _all([inner.match, *filters])
            return Compiled(match, F.when(match, inner.score).otherwise(F.lit(0.0)), by_ordinal=inner.by_ordinal)
        if isinstance(node, N.Fusion):
            raise QueryError("a fusion stands at the top of a query alone")
        raise QueryError(f"unknown query {type(node).__name__}")

    def rows(self) -> DataFrame:
        """The documents with all columns that compiled clauses refer to, from facts if they are written."""
        if self.written is not None:
            return self.written
        index = self.index
        base = index.docs.select("*", *[index.tokens(f).alias(c) for f, c in self.token_columns.items()])
        return base.select("*", *[c.alias(n) for n, c in self.features.values()])

    def facts(self, queries: Iterable[N.Node] = (), keep: Sequence[str] = ()) -> DataFrame:
        """Write all features that the queries may need, with the columns that they and keep name: the one scan that tokenises."""
        self.learning = True
        for f, terms in self.terms.items():
            if self.schema[f].chunked:
                self.chunks(f)
            else:
                self.length(f)
                for t in terms:
                    self.term_parts(f, t)
        for q in queries:
            self.compile(q)
        self.learning = False
        names = dict.fromkeys([self.index.id_col, *keep, *self.used])
        self.written = materialised(self.rows().select(*names, *[n for n, _ in self.features.values()]), "facts")
        return self.written


def scored(index: Index, queries: dict[str, N.Node], keep: Sequence[str] = (), again: bool = False) -> DataFrame:
    """The id, columns to keep, and for each named query its match, score and scores by ordinal: one scan.

    With ``again``, the result is read more than once; the scan is not.
    """
    queries = {k: N.flattened(q) for k, q in queries.items()}
    wanted: dict[str, set[str]] = {}
    for q in queries.values():
        for f, terms in Planner(index).wanted(q).items():
            wanted.setdefault(f, set()).update(terms)
    plan = Planner(index, wanted)
    missing = index.missing(wanted)
    if missing or again:
        facts = plan.facts(queries.values(), keep)
        if missing:
            index.learn(missing, plan, facts)
    done = {k: plan.compile(q) for k, q in queries.items()}
    out = []
    for k, c in done.items():
        out += [c.match.alias(f"{k}_match"), c.score.alias(f"{k}_score")]
        if c.by_ordinal is not None:
            out.append(c.by_ordinal.alias(f"{k}_ordinals"))
    return plan.rows().select(index.id_col, *keep, *out)


def hits(index: Index, query: N.Node, keep: list[str] = ()) -> DataFrame:
    """(id, score, kept columns) of every match, in no order."""
    rows = scored(index, {"q": query}, keep)
    return rows.filter("q_match").select(index.id_col, F.col("q_score").alias("score"), *keep)


def ordinal_hits(index: Index, query: N.Node) -> DataFrame:
    """(id, ordinal, score) of every matching value of a chunked or multi-valued field."""
    rows = scored(index, {"q": query}).filter("q_match")
    if "q_ordinals" not in rows.columns:
        raise QueryError("this query has no scores by ordinal")
    each = rows.select(index.id_col, F.posexplode("q_ordinals").alias("ordinal", "score"))
    return each.filter(F.col("score").isNotNull())


def count(index: Index, query: N.Node) -> DataFrame:
    """(total): the exact number of matches."""
    return scored(index, {"q": query}).agg(F.count_if("q_match").alias("total"))

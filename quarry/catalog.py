"""Registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import ranking
from quarry.plans import nodes as N, planner, ql
from quarry.plans.planner import Index
from quarry.schema import parse_schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6

DOCUMENTS = parse_schema("""
index documents {
    field doc_id: i64 [stored, fast]
    field text: text<simple> [indexed<token_position>, stored]
    field lang: text<raw> [indexed, stored, fast]
    field source: text<raw_ci> [indexed, stored, fast]
    field n_chars: u64 [stored, fast]
    field chunks: text<simple> [indexed<chunked, token_position>, stored]
    default_fields: [text]
}
""")


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL for the same rows if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> Index:
    docs = table(spark, sf_dir, "documents")
    return Index(docs.withColumn("chunks", F.filter(F.split("text", "\n"), lambda c: c != "")), DOCUMENTS)


def best(hits: DataFrame, k: int = 10, offset: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The k best by rounded score, so that engines that add in another order agree on ties."""
    return ranking.top_k(hits.withColumn("score", F.round("score", DIGITS)), k, offset, id_col)


def every(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", DIGITS))


def on_documents(name: str, node: N.Node | str, sql: str | None, k: int | None = 10, offset: int = 0) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = documents(spark, sf_dir)
        hits = planner.hits(index, ql.parse(node, ("text",)) if isinstance(node, str) else node)
        return best(hits, k, offset) if k else every(hits)

    query(name, sql)(run)


# SQL that the oracles share

TOKENS = r"list_filter(string_split_regex(lower(regexp_replace({}, '[^\p{{L}}\p{{N}}\s]', '', 'g')), '\s+'), lambda x: x <> '')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def doc_sql(terms: list[str], body: str, extra: str = "") -> str:
    """tok (doc_id, t, len, tf0.., the documents' columns) with stats (n, avgl, idf0..) beside, then body."""
    tf = "".join(f", len(list_filter(t, lambda x: x = {_quoted(w)})) as tf{i}" for i, w in enumerate(terms))
    idf = "".join(f", ln((count(*) - count_if(tf{i} > 0) + 0.5) / (count_if(tf{i} > 0) + 0.5) + 1) as idf{i}" for i in range(len(terms)))
    return f"""with raw as (select doc_id, lang, source, n_chars, text, {TOKENS.format('text')} as t from documents),
        tok as (select *, len(t) as len{tf} from raw),
        stats as (select count(*) as n, greatest(sum(len) / count(t), 1.0) as avgl{idf} from tok){extra}
        {body}"""


def weight(tf: str, idf: str, length: str = "len") -> str:
    return f"case when {tf} > 0 then {idf} * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {length} / avgl)) else 0 end"


def w(i: int, factor: float = 1.0) -> str:
    return weight(f"tf{i}", f"({factor} * idf{i})")


def top(select: str, k: int | None = 10, offset: int = 0) -> str:
    return f"select doc_id, round(score, {DIGITS}) as score from ({select})" + (f" order by 2 desc, 1 limit {k} offset {offset}" if k else "")


def simple_sql(terms: list[str], score: str, match: str, k: int | None = 10, offset: int = 0) -> str:
    return doc_sql(terms, top(f"select doc_id, {score} as score from tok, stats where {match}", k, offset))


# Text statistics


@query(
    "tokenize_simple_stats",
    f"with tok as (select {TOKENS.format('text')} as t from documents) select count(*) as n_docs, sum(len(t)) as n_tokens, (select count(distinct x) from (select unnest(t) as x from tok)) as n_terms from tok",
)
def tokenize_simple_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents(spark, sf_dir)
    tokens = index.docs.select(index.tokens("text").alias("t"))
    terms = tokens.select(F.explode("t").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    totals = terms.agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_terms"))
    return tokens.agg(F.count("*").alias("n_docs")).join(F.broadcast(totals), F.lit(True)).select("n_docs", "n_tokens", "n_terms")


@query("field_stats", f"with tok as (select {TOKENS.format('text')} as t from documents) select 'text' as field, count(*) as n_units, sum(len(t)) as total_tokens, round(sum(len(t)) / count(*), 6) as avg_len from tok")
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators import postings

    return postings.field_stats(documents(spark, sf_dir), ["text"]).withColumn("avg_len", F.round("avg_len", DIGITS))


@query(
    "vocab_df",
    f"with tok as (select unnest(list_distinct({TOKENS.format('text')})) as term from documents) select term, count(*) as df from tok group by term having count(*) >= 5",
)
def vocab_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents(spark, sf_dir)
    terms = index.docs.select(F.explode(F.array_distinct(index.tokens("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).filter("df >= 5")


@query(
    "postings_term",
    f"""with tok as (select doc_id, {TOKENS.format('text')} as t from documents)
    select 'thing' as term, doc_id, len(list_filter(t, lambda x: x = 'thing')) as tf, len(t) as length,
        list_aggregate(list_transform(list_filter(range(len(t)), lambda i: t[i + 1] = 'thing'), lambda i: i::varchar), 'string_agg', ',') as positions
    from tok where list_contains(t, 'thing')""",
)
def postings_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators import postings

    rows = postings.postings(documents(spark, sf_dir), "text").filter(F.col("term") == "thing")
    return rows.select("term", "doc_id", "tf", "length", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


# Leaves

on_documents("bm25_term", N.Term("text", "thing"), simple_sql(["thing"], w(0), "tf0 > 0"))
on_documents("bm25_match_topk", N.Match("text", "and of"), simple_sql(["and", "of"], f"{w(0)} + {w(1)}", "tf0 > 0 or tf1 > 0"))
on_documents("bm25_match_repeated", N.Match("text", "and of of"), simple_sql(["and", "of"], f"{w(0)} + {w(1, 2.0)}", "tf0 > 0 or tf1 > 0"))
on_documents("term_all_tokens", N.Term("text", "the of"), simple_sql(["the", "of"], f"{w(0)} + {w(1)}", "tf0 > 0 and tf1 > 0", None), None)
on_documents("all_documents", N.All(), "select doc_id, 1.0::double as score from documents", None)

_CAP = ["the", "of", "and", "thing", "in", "zzzz"]
on_documents(
    "match_max_terms", N.Match("text", " ".join(_CAP), max_terms=2),
    doc_sql(_CAP, "select doc_id, round(score, 6) as score from (select doc_id, " + " + ".join(
        f"case when rk{i} <= 2 then {w(i)} else 0 end" for i in range(len(_CAP))) + " as score from tok, stats, ranks) where score > 0 order by 2 desc, 1 limit 10",
        ", dfs as (select " + ", ".join(f"count_if(tf{i} > 0) as d{i}" for i in range(len(_CAP))) + " from tok), ranks as (select " + ", ".join(
            f"(select count(*) + 1 from (values " + ", ".join(f"({j}, d{j})" for j in range(len(_CAP)) if j != i) + f") v(j, d) where ((d = 0)::int, d, j) < ((d{i} = 0)::int, d{i}, {i})) as rk{i}" for i in range(len(_CAP))) + " from dfs)"),
)


def phrase_sql(words: list[tuple[int, str]], slop: int, k: int | None = 10) -> str:
    near = lambda d, x: "(" + " or ".join(f"t[i + {1 + d + s}] = '{x}'" if d + s >= -10**6 else "" for s in range(-slop, slop + 1)) + ")"
    # A position before the first has no token: t[0] and below would count from the end.
    safe = lambda d, x: "(" + " or ".join(f"(i + {d + s} >= 0 and t[i + {1 + d + s}] = '{x}')" for s in range(-slop, slop + 1)) + ")"
    test = " and ".join([f"t[i + 1] = '{words[0][1]}'"] + [safe(d, x) if slop else near(d, x) for d, x in words[1:]])
    names = [x for _, x in words]
    idf = " + ".join(f"idf{i}" for i in range(len(names)))
    return doc_sql(names, top(f"select doc_id, {weight('pf', f'({idf})')} as score from (select *, len(list_filter(range(len(t)), lambda i: {test})) as pf from tok) x, stats where pf > 0", k))


on_documents("phrase_exact", N.Phrase("text", "of the"), phrase_sql([(0, "of"), (1, "the")], 0))
on_documents("phrase_three", N.Phrase("text", "de la les"), phrase_sql([(0, "de"), (1, "la"), (2, "les")], 0, None), None)
on_documents("phrase_slop", N.Phrase("text", "the and thing", 2), phrase_sql([(0, "the"), (1, "and"), (2, "thing")], 2))
on_documents("prefix_docs", N.Prefix("text", "tiont"), doc_sql([], top("select doc_id, 1.0::double as score from tok where len(list_filter(t, lambda x: starts_with(x, 'tiont'))) > 0", None)), None)
on_documents("wildcard_docs", 'th*ea?', doc_sql([], top("select doc_id, 1.0::double as score from tok where len(list_filter(t, lambda x: regexp_full_match(x, '(?s)th.*ea.'))) > 0", None)), None)
on_documents("wildcard_call", 'text:wildcard("*keit?st")', doc_sql([], top("select doc_id, 1.0::double as score from tok where len(list_filter(t, lambda x: regexp_full_match(x, '(?s).*keit.st'))) > 0", None)), None)
on_documents("regex_docs", 'text:regex("(th|st)[aeiou]{2}(nd|st)+")', doc_sql([], top("select doc_id, 1.0::double as score from tok where len(list_filter(t, lambda x: regexp_full_match(x, '(th|st)[aeiou]{2}(nd|st)+'))) > 0", None)), None)
on_documents("raw_field_term", N.Term("lang", "fr"), "with s as (select count(*) as n, count_if(lang = 'fr') as df from documents) select doc_id, round(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / 2.2, 6) as score from documents, s where lang = 'fr'", None)


ORDERS = parse_schema("index orders { field o_orderkey: i64 [fast] field o_totalprice: f64 [fast] field o_orderstatus: text<raw> [indexed, fast] }")
EVENTS = parse_schema("index events { field event_id: i64 [fast] field user_id: i64 [fast] field event_type: text<raw> [indexed, fast] field value: f64 [fast] }")


@query("range_f64", "select o_orderkey, 1.0::double as score from orders where o_totalprice between 1000.0 and 20000.0")
def range_f64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.hits(Index(table(spark, sf_dir, "orders"), ORDERS, "o_orderkey"), N.Range("o_totalprice", 1000.0, 20000.0))


@query("range_open_min", "select event_id, 1.0::double as score from events where value <= 5.0")
def range_open_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.hits(Index(table(spark, sf_dir, "events"), EVENTS, "event_id"), N.Range("value", None, 5.0))


@query("range_exists", "select doc_id, 1.0::double as score from documents d left join labels l using (doc_id) where l.quality is not null")
def range_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return planner.hits(Index(docs, parse_schema("index labelled { field quality: i64 [fast] }")), N.Range("quality"))


@query("range_multi_first", "select user_id, 1.0::double as score from (select user_id, list(value order by event_id) as v from events group by user_id) where v[1] between 10.0 and 50.0")
def range_multi_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The first value of several is the one that a range looks at.
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("v"))
    index = Index(rows.select("user_id", F.array("v").alias("v")), parse_schema("index users { field v: f64 [fast, stored<multi>] }"), "user_id")
    return planner.hits(index, N.Range("v", 10.0, 50.0))


# Composition

T = lambda x: N.Term("text", x)

on_documents(
    "bool_must_should_not", "+the thing -of", simple_sql(["the", "thing", "of"], f"{w(0)} + {w(1)}", "tf0 > 0 and tf2 = 0")
)
on_documents("bool_should", N.Boolean(should=(T("thing"), T("der"), T("les"))), simple_sql(["thing", "der", "les"], f"{w(0)} + {w(1)} + {w(2)}", "tf0 > 0 or tf1 > 0 or tf2 > 0"))
on_documents("bool_exclusion_only", "-the", doc_sql(["the"], top("select doc_id, 0.0::double as score from tok where tf0 = 0", None)), None)
on_documents("bool_complement", "thing OR NOT of", simple_sql(["thing", "of"], w(0), "tf0 > 0 or tf1 = 0", None), None)
on_documents("bool_empty", N.Boolean(), "select doc_id, 0.0::double as score from documents where false", None)
on_documents("bool_nested", "+(thing der) -la", simple_sql(["thing", "der", "la"], f"{w(0)} + {w(1)}", "(tf0 > 0 or tf1 > 0) and tf2 = 0"))
on_documents("ql_and_or", "the AND of OR der AND die", simple_sql(["the", "of", "der", "die"], f"case when tf0 > 0 and tf1 > 0 then {w(0)} + {w(1)} else 0 end + case when tf2 > 0 and tf3 > 0 then {w(2)} + {w(3)} else 0 end", "(tf0 > 0 and tf1 > 0) or (tf2 > 0 and tf3 > 0)"))
on_documents("ql_free_text", "the of?! (thing", simple_sql(["the", "of", "thing"], f"{w(0)} + {w(1)} + {w(2)}", "tf0 > 0 or tf1 > 0 or tf2 > 0"))
on_documents(
    "ql_phrase_and_term", '+"of the" +thing',
    doc_sql(["of", "the", "thing"], top(f"select doc_id, {weight('pf', '(idf0 + idf1)')} + {w(2)} as score from (select *, len(list_filter(range(len(t)), lambda i: t[i + 1] = 'of' and t[i + 2] = 'the')) as pf from tok) x, stats where pf > 0 and tf2 > 0")),
)
on_documents("must_filter_with_should", N.Boolean(must=(N.Range("n_chars", 500, 3000),), should=(T("thing"),)), simple_sql(["thing"], w(0), "n_chars between 500 and 3000"))
on_documents("must_filter_alone", N.Boolean(must=(N.Range("n_chars", 500, 3000), N.Prefix("text", "thi"))), doc_sql([], top("select doc_id, 2.0::double as score from tok where n_chars between 500 and 3000 and len(list_filter(t, lambda x: starts_with(x, 'thi'))) > 0", None)), None)
on_documents("filtered_match", N.Filtered(N.Match("text", "and of"), (N.Range("n_chars", 100, 2000), N.Term("lang", "en"))), simple_sql(["and", "of"], f"{w(0)} + {w(1)}", "(tf0 > 0 or tf1 > 0) and n_chars between 100 and 2000 and lang = 'en'"))
on_documents("boost_negative", N.Boolean(must=(T("the"),), should=(N.Boost(T("thing"), -1.5), N.Boost(T("of"), 2.0))), simple_sql(["the", "thing", "of"], f"{w(0)} - 1.5 * ({w(1)}) + 2.0 * ({w(2)})", "tf0 > 0"))
on_documents("topk_offset", N.Match("text", "and of"), simple_sql(["and", "of"], f"{w(0)} + {w(1)}", "tf0 > 0 or tf1 > 0", 5, 7), 5, 7)


@query("count_match", doc_sql(["and", "of"], "select count_if(tf0 > 0 or tf1 > 0) as total from tok"))
def count_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.count(documents(spark, sf_dir), N.Match("text", "and of"))


@query("multi_collector", doc_sql(["and", "of"], f"select count(*) as total, round(max(s), 6) as best, round(sum(s), 3) as sum_score from (select {w(0)} + {w(1)} as s from tok, stats where tf0 > 0 or tf1 > 0)"))
def multi_collector(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = planner.hits(documents(spark, sf_dir), N.Match("text", "and of"))
    return hits.agg(F.count("*").alias("total"), F.round(F.max("score"), DIGITS).alias("best"), F.round(F.sum("score"), 3).alias("sum_score"))


@query("hydrate_fields", doc_sql(["and", "of"], f"select doc_id, round(score, 6) as score, lang, n_chars from (select doc_id, lang, n_chars, {w(0)} + {w(1)} as score from tok, stats where tf0 > 0 or tf1 > 0) order by 2 desc, 1 limit 10"))
def hydrate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.engine import Engine

    index = documents(spark, sf_dir)
    engine = Engine()
    engine.indexes["documents"] = index
    return engine.loaded(index, best(planner.hits(index, N.Match("text", "and of"))), ["lang", "n_chars"])


@query("dict_request", doc_sql(["the", "thing"], top(f"select doc_id, {w(0)} + 0.5 * ({w(1)}) as score from tok, stats where tf0 > 0 and n_chars >= 200")))
def dict_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans import request

    node = request.build({"boolean": {"must": [{"term": {"field": "text", "term": "the"}}, {"range": {"field": "n_chars", "min_u64": 200}}], "should": [{"boost": {"query": {"term": {"field": "text", "term": "thing"}}, "boost": 0.5}}]}})
    return best(planner.hits(documents(spark, sf_dir), node))


@query("match_trailing_star", doc_sql([], top("select doc_id, 1.0::double as score from tok where len(list_filter(t, lambda x: starts_with(x, 'tiont'))) > 0", None)))
def match_trailing_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans import request

    return every(planner.hits(documents(spark, sf_dir), request.build({"match": {"field": "text", "text": "Tiont*"}})))


@query("term_fast_text", "select o_orderkey, 1.0::double as score from orders where o_orderpriority = (select min(o_orderpriority) from orders)")
def term_fast_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text field that is fast only is compared as a whole."""
    orders = table(spark, sf_dir, "orders")
    value = orders.agg(F.min("o_orderpriority")).first()[0]
    schema = parse_schema("index orders { field o_orderkey: i64 [fast] field o_orderpriority: text<raw> [fast] }")
    return planner.hits(Index(orders, schema, "o_orderkey"), N.Term("o_orderpriority", value))


on_documents("bm25f_field_boost", N.Match("text", "and of", field_boost=2.5), simple_sql(["and", "of"], " + ".join(weight(f"(2.5 * tf{i})", f"idf{i}") for i in (0, 1)), "tf0 > 0 or tf1 > 0"))


@query("get_document", "select doc_id, lang, source, n_chars from documents where doc_id = 17")
def get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id = 17").select("doc_id", "lang", "source", "n_chars")


@query("router_additional", doc_sql(["thing"], top("select doc_id, score from (select doc_id, " + w(0) + " + case when source = 'src3' then ln((n - sdf + 0.5) / (sdf + 0.5) + 1) else 0 end as score, tf0, source from tok, stats, (select count_if(source = 'src3') as sdf from documents)) where tf0 > 0 or source = 'src3'")))
def router_additional(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    from quarry.plans import router
    from quarry.schema import Rule

    index = documents(spark, sf_dir)
    index.schema = replace(index.schema, rules=(Rule(r"@(SRC\d+)", "{g(1).lower()}", "source"),))
    node = router.route(index.schema, "thing @SRC3")
    # What the query itself says: the word, and the mention as a word that no text has.
    return best(planner.hits(index, node))


@query("phrase_stopword_gap", doc_sql(["thing", "and"], top(f"""select doc_id, {weight('pf', '(idf0 + idf1)', 'slen')} as score from (select *, len(list_filter(range(len(t)), lambda i: t[i + 1] = 'thing' and t[i + 3] = 'and')) as pf from tok) x,
    (select ln((count(*) - count_if(tf0 > 0) + 0.5) / (count_if(tf0 > 0) + 0.5) + 1) as idf0, ln((count(*) - count_if(tf1 > 0) + 0.5) / (count_if(tf1 > 0) + 0.5) + 1) as idf1, sum(len(list_filter(t, lambda x: x <> 'of'))) / count(*) as avgl from tok) s,
    (select doc_id as d2, len(list_filter(t, lambda x: x <> 'of')) as slen from tok) l where d2 = doc_id and pf > 0""", None)))
def phrase_stopword_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop word inside a phrase keeps its place: any token may stand there."""
    from dataclasses import replace

    from quarry.functions.analysis import SIMPLE, register, with_stop_words

    register("simple_no_of", with_stop_words(SIMPLE, ["of"]))
    index = documents(spark, sf_dir)
    index.schema = replace(index.schema, fields=tuple(replace(f, tokenizer="simple_no_of") if f.name == "text" else f for f in index.schema.fields))
    return every(planner.hits(index, N.Phrase("text", "thing of and")))


@query(
    "proximity_rescore",
    doc_sql(["of", "thing"], top(f"""select doc_id, {w(0)} + {w(1)} + 0.5 * ({weight('o', '((idf0 + idf1) / 2)')} + 0.5 * ({weight('u', '((idf0 + idf1) / 2)')})) as score from (
        select *, len(list_filter(range(len(t) - 1), lambda i: t[i + 1] = 'of' and t[i + 2] = 'thing')) as o,
            coalesce(list_sum(list_transform(list_filter(range(len(t)), lambda i: t[i + 1] = 'of'), lambda i: len(list_filter(range(greatest(i - 8, 0), least(i + 9, len(t))), lambda j: t[j + 1] = 'thing')))), 0) as u from tok) x, stats where tf0 > 0 or tf1 > 0""")),
)
def proximity_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(planner.hits(documents(spark, sf_dir), N.Match("text", "of thing", proximity_weight=0.5)))


# Chunks

def chunk_sql(words: list[str]) -> str:
    """tok (doc_id, ordinal, t, l, tf0..) of chunks, and stats (avgl, floor, idf0..)."""
    tf = "".join(f", len(list_filter(t, lambda x: x = {_quoted(x)})) as tf{i}" for i, x in enumerate(words))
    idf = ", ".join(f"ln((count(*) - count_if(tf{i} > 0) + 0.5) / (count_if(tf{i} > 0) + 0.5) + 1) as idf{i}" for i in range(len(words)))
    return f"""with docs as (select doc_id, list_filter(string_split(text, chr(10)), lambda c: c <> '') as chunks from documents),
    chunk as (select doc_id, unnest(range(len(chunks))) as ordinal, unnest(chunks) as c from docs),
    tok0 as (select doc_id, ordinal, {TOKENS.format('c')} as t from chunk),
    tok as (select *, len(t) as l{tf} from tok0),
    stats as (select greatest(sum(l) / count(*), 1.0) as avgl, quantile_disc(l, 0.9) as floor, {idf} from tok)"""


def cw(i: int) -> str:
    return weight(f"tf{i}", f"idf{i}", "greatest(l, floor)")


CHUNKS = chunk_sql(["thing", "of"]) + f""",
    hit as (select doc_id, ordinal, {cw(0)} + {cw(1)} as s from tok, stats where tf0 > 0 or tf1 > 0) """


@query("chunked_maxp", CHUNKS + "select doc_id, round(max(s), 6) as score from hit group by doc_id order by 2 desc, 1 limit 10")
def chunked_maxp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(planner.hits(documents(spark, sf_dir), N.Match("chunks", "thing of")))


@query("chunk_hits", CHUNKS + "select doc_id, ordinal, round(s, 6) as score from hit")
def chunk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return every(planner.ordinal_hits(documents(spark, sf_dir), N.Match("chunks", "thing of")))


_COMBINED = {
    "sum": "sum(s)", "max": "max(s)", "avg": "avg(s)", "log_sum_exp": "sum(exp(1.5 * (s - m)) * s) / sum(exp(1.5 * (s - m)))",
    "weighted_top_k": "sum(case when r <= 5 then s * pow(0.7, r - 1) end) / sum(case when r <= 5 then pow(0.7, r - 1) end)",
}


def _combined(kind: str) -> None:
    @query(f"combiner_{kind}", CHUNKS + f"select doc_id, round({_COMBINED[kind]}, 6) as score from (select *, max(s) over (partition by doc_id) as m, row_number() over (partition by doc_id order by s desc) as r from hit) group by doc_id")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quarry.functions.scoring import Combiner

        each = planner.ordinal_hits(documents(spark, sf_dir), N.Match("chunks", "thing of"))
        grouped = each.groupBy("doc_id").agg(F.array_sort(F.collect_list("score")).alias("s"))
        return every(grouped.select("doc_id", Combiner(kind).column(F.col("s")).alias("score")))


for _kind in _COMBINED:
    _combined(_kind)


@query("ordinal_window", CHUNKS + """, top1 as (select doc_id, arg_min(ordinal, (-s, ordinal)) as o from (select doc_id, ordinal, round(s, 6) as s from hit) group by doc_id)
    select doc_id, string_agg(c, chr(10) order by ordinal) as passage from chunk join top1 using (doc_id) where abs(ordinal - o) <= 1 group by doc_id""")
def ordinal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planner.scored(documents(spark, sf_dir), {"q": N.Match("chunks", "thing of")}, ["chunks"]).filter("q_match")
    near = ranking.ordinal_window(F.col("chunks"), F.transform("q_ordinals", lambda s: F.round(s, DIGITS)), 1, 1)
    return rows.select("doc_id", F.array_join(near, "\n").alias("passage"))


@query("phrase_in_chunk", chunk_sql(["of", "the"]) + f""", hit as (select doc_id, {weight('pf', '(idf0 + idf1)', 'greatest(l, floor)')} as s
    from (select *, len(list_filter(range(len(t)), lambda i: t[i + 1] = 'of' and t[i + 2] = 'the')) as pf from tok) x, stats where pf > 0) select doc_id, round(max(s), 6) as score from hit group by doc_id""")
def phrase_in_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase doesn't cross the end of a chunk."""
    return every(planner.hits(documents(spark, sf_dir), N.Phrase("chunks", "of the")))


@query("stem_en_match", None)
def stem_en_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    index = documents(spark, sf_dir)
    index.schema = replace(index.schema, fields=tuple(replace(f, tokenizer="en_stem") if f.name == "text" else f for f in index.schema.fields))
    return best(planner.hits(index, N.Match("text", "things ended")))


from quarry import catalog_vectors, catalog_corpus  # noqa: E402, F401, I001  their queries register themselves

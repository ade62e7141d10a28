"""How often a query makes each document's text: once, however many of its steps need it."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quarry import catalog, catalog_corpus

CORPUS = ["curriculum_compose", "corpus_manifest", "corpus_token_budget", "corpus_dedup", "corpus_shards", "corpus_render", "corpus_classify"]
SEARCH = ["rrf_chunk", "score_export", "stem_en_match", "combiner_log_sum_exp", "ordinal_window", "rrf_doc", "nws_fusion", "l1_formula"]


def texts_made(spark, monkeypatch, run) -> float:
    """Texts that run(spark, sf_dir) takes from documents, over the number of documents."""
    seen, table = spark.sparkContext.accumulator(0), catalog.table

    def counted(text):
        seen.add(1)
        return text

    def counting(spark, sf_dir, name):
        rows = table(spark, sf_dir, name)
        return rows.withColumn("text", F.udf(counted, "string")("text")) if name == "documents" else rows

    for module in (catalog, catalog_corpus):
        monkeypatch.setattr(module, "table", counting)
    run(spark, SMALL).collect()
    return seen.value / table(spark, SMALL, "documents").count()


@pytest.mark.parametrize("name", CORPUS + SEARCH)
def test_each_text_once(spark, monkeypatch, name):
    assert texts_made(spark, monkeypatch, catalog.QUERIES[name]) == 1


@pytest.mark.parametrize("name", ["corpus_normalize", *CORPUS[:-1]])
def test_normalised_once(spark, monkeypatch, name):
    """No filter or projection repeats the patterns that normalise a text, in what is planned or written on the way."""
    from quarry.operators import corpus

    plans = []
    written = corpus.materialised
    monkeypatch.setattr(corpus, "materialised", lambda df, name: (plans.append(df), written(df, name))[1])
    plans.append(catalog.QUERIES[name](spark, SMALL))
    assert sum(p._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(text") for p in plans) == 1


def test_compose_brute_force(spark):
    """Three strata, empty records, records above what is wanted, a maximum: the greedy choice, one record at a time."""
    import hashlib
    import random

    from quarry.operators import corpus

    pick = random.Random(5)
    rows = [(f"k{i:04d}", pick.choice([0, 1, 7, 40, 300]), pick.choice("abcd")) for i in range(900)]
    weights = {"a": 2.0, "b": 1.0, "c": 0.5}
    stage = corpus.Stage("s", 2000, tuple(corpus.Stratum(s, F.col("topic") == s, w) for s, w in weights.items()), maximum=2100)
    got = corpus.compose(spark.createDataFrame(rows, "record_key string, n_tokens int, topic string").repartition(5), [stage])
    queue = {s: [r for r in rows if r[2] == s] for s in weights}
    emitted, want = dict.fromkeys(weights, 0), []
    while sum(emitted.values()) < 2000 and any(queue.values()):
        s = min((s for s in weights if queue[s]), key=lambda s: (emitted[s] / weights[s], hashlib.sha256(f"17:s:{s}".encode()).hexdigest()))
        key, n, _ = queue[s].pop(0)
        if sum(emitted.values()) + n > 2100:
            break
        emitted[s] += n
        want.append((len(want), key, s, n))
    assert [(r.position, r.record_key, r.stratum, r.n_tokens) for r in got.orderBy("position").collect()] == want


def test_facts_say_what_a_scan_says(spark):
    """Queries over written facts, with statistics from them, and over a scan with the same statistics."""
    from quarry.functions import scoring
    from quarry.plans import nodes as N, planner
    from quarry.plans.planner import Index
    from quarry.schema import parse_schema

    schema = parse_schema("""index t {
        field text: text<simple> [indexed<token_position>] field chunks: text<simple> [indexed<chunked, token_position>]
        field code: text<raw> [indexed, fast] field whole: text<raw> [fast] field n: i64 [fast]
    }""")
    words = [f"w{i:02d}" for i in range(70)]
    rows = [
        (0, "of the w01 of the thing", ["of the", "thing of", None], "EN", "a b", 1), (1, None, None, None, None, None), (2, "", [], "en", "", 2), (3, " ".join(words), ["w01 w02", "", "of the the"], "EN", "a b", 3),
        (4, "the of thing the of", ["the", "of the thing of the"], "en", "c", -1), (5, "thing! Of. THE (the) of", [None], " en", "a b", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string, chunks array<string>, code string, whole string, n long")
    queries = [
        N.Match("text", "of the thing"), N.Match("text", "of the thing w01", max_terms=2, proximity_weight=0.5), N.Phrase("text", "of the"), N.Phrase("text", "of thing", 2), N.Match("chunks", "of the"),
        N.Phrase("chunks", "of the"), N.Term("chunks", "the of"), N.Prefix("text", "th"), N.Term("code", "EN"), N.Term("code", "en"), N.Boolean(should=tuple(N.Term("text", w) for w in words)),
        N.Boolean(must=(N.Range("n", 1, 4),), should=(N.Term("whole", "a b"), N.Term("text", "of"))), N.Boost(N.Match("text", "zzz of", field_boost=2.0), -1.0), N.All(),
    ]
    one = Index(docs, schema)
    facts = planner.scored(one, {f"q{i}": q for i, q in enumerate(queries)}, ["n"])
    scan = planner.scored(Index(docs, schema, stats=one.known), {f"q{i}": q for i, q in enumerate(queries)}, ["n"])
    again = planner.scored(one, {f"q{i}": q for i, q in enumerate(queries)}, ["n"], again=True)
    assert facts.columns == scan.columns
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(facts) == rows(scan) == rows(again)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan(scan) and not any("regexp_replace" in plan(x) for x in (facts, again))
    # By hand: lengths, holders and frequencies without nulls.
    text, chunks = one.known["text"], one.known["chunks"]
    assert (text.n, text.holders, text.tokens, text.df["of"], text.df["w01"]) == (6, 5, 6 + 0 + 70 + 5 + 5, 3, 2)
    assert (chunks.n, chunks.tokens, chunks.floor, chunks.df["of"], chunks.df["the"]) == (7, 2 + 2 + 2 + 0 + 3 + 1 + 5, 5, 4, 4)
    got = {r.doc_id: r.q8_score for r in facts.filter("q8_match").collect()}
    assert got.keys() == {0, 3} and all(abs(x - scoring.idf(6, 2)) < 1e-9 for x in got.values())

"""Queries over vectors, and over several ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.catalog import DIGITS, best, chunk_sql, cw, doc_sql, documents, every, query, table, w
from quarry.functions import scoring
from quarry.functions.scoring import Combiner
from quarry.operators import ranking
from quarry.plans import nodes as N, planner
from quarry.plans.planner import Index
from quarry.schema import parse_schema

EMBEDDINGS = parse_schema("""
index embeddings {
    field vec_id: i64 [stored, fast]
    field embedding: dense_vector<64> [indexed, stored]
    field label: i64 [stored, fast]
    field code: binary_dense_vector<64> [indexed]
    field sparse: sparse_vector<u16> [indexed]
    field parts: dense_vector<32> [indexed, stored<multi>]
}
""")

#: A fixed query vector, and the dims of a sparse query.
VECTOR = [((i * 7) % 11 - 5) / 5 for i in range(64)]
DIMS = ((3, 1.0), (17, 0.5), (40, 2.0), (58, -0.25))
CODE = sum(1 << i for i in range(64) if VECTOR[i] > 0)
CODE -= (1 << 64) * (CODE >= 1 << 63)


def embeddings(spark: SparkSession, sf_dir: str) -> Index:
    v = F.col("embedding")
    entries = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("dim"), x.alias("weight"))), lambda e: e["weight"] > 0.1)
    rows = table(spark, sf_dir, "embeddings").withColumns({"code": scoring.sign_bits(v, 64), "sparse": entries, "parts": F.array(F.slice(v, 1, 32), F.slice(v, 33, 32))})
    return Index(rows, EMBEDDINGS, "vec_id")


def vec_top(hits: DataFrame, k: int = 10) -> DataFrame:
    return best(hits, k, 0, "vec_id")


LIST = "[" + ", ".join(map(str, VECTOR)) + "]::double[]"
V = "list_transform(embedding, lambda x: x::double)"
COSINE = f"list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * ({LIST})[i])) / (sqrt(list_sum(list_transform({V}, lambda x: x * x))) * {sum(x * x for x in VECTOR)!r} ** 0.5)"
CODES = "(select vec_id, label, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as bits from embeddings)"
QBITS = "[" + ", ".join(str(int(x > 0)) for x in VECTOR) + "]"
HAMMING = f"(1.0 - list_sum(list_transform(range(1, 65), lambda i: case when bits[i] <> ({QBITS})[i] then 1.0 else 0.0 end)) / 64)"


def _dense(rows: str = "embeddings", extra: str = "true", k: int = 10) -> str:
    return f"select vec_id, round({COSINE}, 6) as score from {rows} where {extra} order by 2 desc, 1 limit {k}"


@query("dense_topk", _dense())
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec_top(planner.hits(embeddings(spark, sf_dir), N.Dense("embedding", tuple(VECTOR))))


@query("dense_by_label_filter", _dense(extra="label between 3 and 5"))
def dense_by_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec_top(planner.hits(embeddings(spark, sf_dir), N.Filtered(N.Dense("embedding", tuple(VECTOR)), (N.Range("label", 3, 5),))))


@query("dense_multi_value", "with half as (select vec_id, h, list_transform(range(1, 33), lambda i: embedding[h * 32 + i]::double) as v from embeddings, (values (0), (1)) t(h)) "
       f"select vec_id, round(max(list_sum(list_transform(range(1, 33), lambda i: v[i] * ({LIST})[i])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * {sum(x * x for x in VECTOR[:32])!r} ** 0.5)), 6) as score from half group by vec_id order by 2 desc, 1 limit 10")
def dense_multi_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec_top(planner.hits(embeddings(spark, sf_dir), N.Dense("parts", tuple(VECTOR[:32]))))


@query("binary_hamming_topk", f"select vec_id, round({HAMMING}, 6) as score from {CODES} order by 2 desc, 1 limit 10")
def binary_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec_top(planner.hits(embeddings(spark, sf_dir), N.Binary("code", (CODE,), 64)))


_SPARSE = " + ".join(f"case when embedding[{d + 1}] > 0.1 then embedding[{d + 1}]::double * {x} else 0 end" for d, x in DIMS)
_SHARES = " or ".join(f"embedding[{d + 1}] > 0.1" for d, _ in DIMS)


@query("sparse_dot_topk", f"select vec_id, round({_SPARSE}, 6) as score from embeddings where {_SHARES} order by 2 desc, 1 limit 10")
def sparse_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec_top(planner.hits(embeddings(spark, sf_dir), N.Sparse("sparse", DIMS)))


@query("sparse_query_pruned", f"select vec_id, round({' + '.join(f'case when embedding[{d + 1}] > 0.1 then embedding[{d + 1}]::double * {x} else 0 end' for d, x in ((40, 2.0), (3, 1.0)))}, 6) as score from embeddings where embedding[41] > 0.1 or embedding[4] > 0.1 order by 2 desc, 1 limit 10")
def sparse_query_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans.request import pruned

    return vec_top(planner.hits(embeddings(spark, sf_dir), N.Sparse("sparse", tuple(pruned(list(DIMS), share=0.5)))))


@query("sparse_idf_weights", "with dims as (select unnest(list_filter(range(64), lambda i: embedding[i + 1] > 0.1)) as dim from embeddings) select dim, count(*) as df, round(greatest(ln((select count(*) from embeddings) / count(*)), 0), 6) as weight from dims group by dim")
def sparse_idf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).docs
    n = rows.count()
    dims = rows.select(F.explode(F.transform("sparse", lambda e: e["dim"].cast("long"))).alias("dim")).groupBy("dim").agg(F.count("*").alias("df"))
    return dims.select("dim", "df", F.round(F.greatest(F.ln(F.lit(float(n)) / F.col("df")), F.lit(0.0)), DIGITS).alias("weight"))


def doc_mass(entries, share: float, least: int, threshold: float = 0.0):
    """Sparse document weights without the light ones: the heaviest that cover a share of the mass stay.

    Only vectors of more than ``least`` entries are cropped; entries below the threshold go first.
    """
    heavy = F.array_sort(F.transform(F.filter(entries, lambda e: F.abs(e["weight"]) >= threshold), lambda e: F.struct((-F.abs(e["weight"].cast("double"))).alias("w"), e["dim"].alias("dim"), e["weight"].alias("weight"))))
    total = F.aggregate(heavy, F.lit(0.0), lambda s, e: s - e["w"])
    before = lambda i: F.aggregate(F.slice(heavy, 1, i), F.lit(0.0), lambda s, e: s - e["w"])
    kept = F.filter(heavy, lambda e, i: before(i) < F.lit(share) * total)
    return F.transform(F.when(F.size(heavy) > least, kept).otherwise(heavy), lambda e: F.struct(e["dim"].alias("dim"), e["weight"].alias("weight")))


@query("sparse_doc_mass", """with e as (select vec_id, i as dim, embedding[i + 1]::double as x from (select vec_id, embedding, unnest(range(64)) as i from embeddings) where embedding[i + 1] > 0.1),
    r as (select *, coalesce(sum(x) over (partition by vec_id order by x desc, dim rows between unbounded preceding and 1 preceding), 0) as before, sum(x) over (partition by vec_id) as total, count(*) over (partition by vec_id) as n from e)
    select vec_id, count(*) as n_kept, round(sum(x), 6) as mass from r where n <= 4 or before < 0.8 * total group by vec_id""")
def sparse_doc_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).docs.select("vec_id", doc_mass(F.col("sparse"), 0.8, 4).alias("kept")).filter(F.size("kept") > 0)
    return rows.select("vec_id", F.size("kept").cast("long").alias("n_kept"), F.round(F.aggregate("kept", F.lit(0.0), lambda s, e: s + e["weight"].cast("double")), DIGITS).alias("mass"))


_U8 = "list_transform(embedding, lambda x: floor((least(greatest(x::float, (-1)::float), 1::float) + 1::float) * 127.5::float)::int)"


@query("u8_round_trip", f"with q as (select vec_id, {_U8} as c from embeddings) select vec_id, list_sum(c)::bigint as codes, round(list_sum(list_transform(c, lambda x: (x::float * (1 / 127.5)::float - 1::float)::double)), 4) as total from q")
def u8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in a byte a component: the sums of the codes and of what they stand for."""
    from quarry.functions.quantise import u8_codes, u8_values

    rows = table(spark, sf_dir, "embeddings").select("vec_id", u8_codes(F.col("embedding")).alias("c")).withColumn("v", u8_values(F.col("c")))
    return rows.select("vec_id", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("codes"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


# Reranking: a first ranking by code, a second by vector

_FIRST = f"select vec_id, row_number() over (order by score desc, vec_id) as r1 from (select vec_id, round({HAMMING}, 6) as score from {CODES}) qualify r1 <= 100"
_SECOND = f"with one as ({_FIRST}), two as (select vec_id, r1, round({COSINE}, 6) as score from embeddings join one using (vec_id)) "


def first_by_code(index: Index) -> DataFrame:
    return every(planner.hits(index, N.Binary("code", (CODE,), 64)))


@query("rerank_cosine", _SECOND + "select vec_id, score from two order by 2 desc, 1 limit 10")
def rerank_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = embeddings(spark, sf_dir)
    return ranking.rerank(first_by_code(index), index.docs, "embedding", VECTOR, 10, 100, "vec_id", digits=DIGITS)


@query("rerank_rrf", _SECOND + "select vec_id, round(1 / (60 + r1) + 1 / (60 + r2), 6) as score from (select *, row_number() over (order by score desc, vec_id) as r2 from two) order by 1 / (60.0 + r1) + 1 / (60.0 + r2) desc, 1 limit 10")
def rerank_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = embeddings(spark, sf_dir)
    out = ranking.rerank(first_by_code(index), index.docs, "embedding", VECTOR, 10, 100, "vec_id", rrf_k=60, digits=DIGITS)
    return every(out)


_PREFIX = f"round(list_sum(list_transform(range(1, 17), lambda i: embedding[i]::double * ({LIST})[i])) / (sqrt(list_sum(list_transform({V}[1:16], lambda x: x * x))) * {sum(x * x for x in VECTOR[:16])!r} ** 0.5), 6)"


@query("matryoshka_prefilter", f"with one as ({_FIRST}), pre as (select vec_id from embeddings join one using (vec_id) order by {_PREFIX} desc, vec_id limit 20) select vec_id, round({COSINE}, 6) as score from embeddings join pre using (vec_id) order by 2 desc, 1 limit 10")
def matryoshka_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = embeddings(spark, sf_dir)
    return ranking.rerank(first_by_code(index), index.docs, "embedding", VECTOR, 10, 100, "vec_id", prefix=16, digits=DIGITS)


@query("retrieval_metrics", """with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
    n as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from v),
    p as (select q.vec_id as qid, q.label = c.label as relevant, round(list_sum(list_transform(range(1, 65), lambda i: q.v[i] * c.v[i])) / (q.norm * c.norm), 6) as s from n q join n c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
    b as (select qid, max(s) filter (relevant) as best from p group by qid having best is not null),
    r as (select qid, count_if(not relevant and s >= best) + 1 as rank from p join b using (qid) group by qid)
    select count(*) as n_queries, round(avg((rank <= 1)::int), 6) as top1, round(avg(1.0 / rank), 6) as mrr, round(avg((rank <= 1)::int), 6) as recall_1, round(avg((rank <= 10)::int), 6) as recall_10,
        round(avg(case when rank <= 10 then 1 / log2(rank + 1) else 0 end), 6) as ndcg_10 from r""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranking.relevance(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, "vec_id", "embedding", "label")
    return got.select("n_queries", *[F.round(c, DIGITS).alias(c) for c in got.columns[1:]])


# Several lists: words, chunks, lengths

T = lambda x: N.Term("text", x)
BRANCHES = (N.Branch(N.Match("text", "and of"), 1.0, "a"), N.Branch(N.Match("text", "thing the"), 2.0, "b"), N.Branch(T("thing"), 0.5, "c"))
FUSION = N.Fusion(BRANCHES, depth=50)
_LISTS = doc_sql(["and", "of", "thing", "the"], "", f""", branch as (
        select 0 as b, doc_id, round({w(0)} + {w(1)}, 6) as s from tok, stats where tf0 > 0 or tf1 > 0
        union all select 1, doc_id, round({w(2)} + {w(3)}, 6) from tok, stats where tf2 > 0 or tf3 > 0
        union all select 2, doc_id, round({w(2)}, 6) from tok, stats where tf2 > 0),
    lists as (select *, row_number() over (partition by b order by s desc, doc_id) as r from branch qualify r <= 50),
    weights as (select * from (values (0, 1.0::double), (1, 2.0), (2, 0.5)) t(b, weight))""")  # fmt: skip


@query("rrf_doc", _LISTS + "select doc_id, round(sum(weight / (60 + r)), 6) as score from lists join weights using (b) group by doc_id order by 2 desc, 1 limit 10")
def rrf_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(ranking.fuse(documents(spark, sf_dir), FUSION, DIGITS))


@query("nws_fusion", _LISTS + """select doc_id, round(sum(weight * case when hi > lo then (s - lo) / (hi - lo) else 1 end), 6) as score
    from lists join weights using (b) join (select b, min(s) as lo, max(s) as hi from lists group by b) using (b) group by doc_id order by 2 desc, 1 limit 10""")
def nws_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(ranking.fuse(documents(spark, sf_dir), N.Fusion(BRANCHES, "normalized_weighted_sum", depth=50), DIGITS))


@query("rrf_votes", _LISTS + "select doc_id, b::int as branch, 0 as ordinal, r::int as rank, round(weight / (60 + r), 6) as contribution from lists join weights using (b)")
def rrf_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranking.rrf_scores(documents(spark, sf_dir), FUSION, DIGITS)
    return got.withColumn("contribution", F.round("contribution", DIGITS))


_FEATURES = _LISTS + f""", nominated as (select doc_id, sum(weight / (60 + r)) as rrf from lists join weights using (b) group by doc_id),
    features as (select doc_id, case when tf0 > 0 or tf1 > 0 then round({w(0)} + {w(1)}, 6) end as a, case when tf2 > 0 or tf3 > 0 then round({w(2)} + {w(3)}, 6) end as b, case when tf2 > 0 then round({w(2)}, 6) end as c, rrf
        from tok join nominated using (doc_id), stats) """


@query("score_export", _FEATURES + "select doc_id, a, b, c, round(rrf, 6) as rrf from features")
def score_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.score_export(documents(spark, sf_dir), FUSION, DIGITS).withColumn("rrf", F.round("rrf", DIGITS))


@query("l1_formula", _FEATURES + "select doc_id, round(2 * ln(1 + coalesce(a, 0)) + sqrt(abs(coalesce(b, 0))) - 0.25 * pow(-coalesce(c, 0.5), 2) + 100 * rrf + log2(8), 6) as score from features order by 2 desc, 1 limit 10")
def l1_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranking.formula_rank(documents(spark, sf_dir), FUSION, "2 * ln(1 + a) + sqrt(abs(b)) - 0.25 * -c^2 + 100 * rrf + log2(8)", {"c": 0.5}, True, DIGITS)
    return best(hits)


@query("l1_without_backfill", _LISTS + """, f as (select doc_id, max(case when b = 0 then s end) as a, max(case when b = 1 then s end) as b from lists group by doc_id)
    select doc_id, round(coalesce(a, 0) + 0.5 * coalesce(b, 0), 6) as score from f order by 2 desc, 1 limit 10""")
def l1_without_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(ranking.formula_rank(documents(spark, sf_dir), FUSION, "a + 0.5 * b", None, False, DIGITS))


@query("rrf_chunk", chunk_sql(["thing", "of", "and", "the"]) + f""", branch as (
        select 0 as b, doc_id, ordinal, round({cw(0)} + {cw(1)}, 6) as s from tok, stats where tf0 > 0 or tf1 > 0
        union all select 1, doc_id, ordinal, round({cw(2)} + {cw(3)}, 6) from tok, stats where tf2 > 0 or tf3 > 0),
    lists as (select *, row_number() over (partition by b order by s desc, doc_id, ordinal) as r from branch qualify r <= 200),
    passage as (select doc_id, ordinal, sum(1.0 / (60 + r)) as vote from lists group by all)
    select doc_id, round(max(vote), 6) as score from passage group by doc_id order by 2 desc, 1 limit 10""")
def rrf_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of two branches, fused by ordinal; a document takes its best passage."""
    branches = (N.Branch(N.Match("chunks", "thing of"), 1.0, scope="chunk"), N.Branch(N.Match("chunks", "and the"), 1.0, scope="chunk"))
    return best(ranking.fuse(documents(spark, sf_dir), N.Fusion(branches, depth=200, combiner=Combiner("max")), DIGITS))


@query("hybrid_dict_request", f"""with a as (select vec_id, row_number() over (order by s desc, vec_id) as r from (select vec_id, {COSINE} as s from embeddings) qualify r <= 100),
    b as (select vec_id, row_number() over (order by s desc, vec_id) as r from (select vec_id, {HAMMING} as s from {CODES}) qualify r <= 100),
    fused as (select vec_id, sum(vote) as vote from (select vec_id, 1.0::double / (60.0::double + r) as vote from a union all select vec_id, 0.5::double / (60.0::double + r) from b) group by vec_id),
    first as (select vec_id from fused order by vote desc, vec_id limit 50)
    select vec_id, round({COSINE}, 6) as score from embeddings join first using (vec_id) order by {COSINE} desc, vec_id limit 10""")
def hybrid_dict_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fusion of a vector and a code branch, as a structured request, with a reranker."""
    from quarry.engine import Engine

    engine = Engine()
    engine.indexes["v"] = embeddings(spark, sf_dir)
    spec = {"fusion": {"queries": [{"query": {"dense_vector": {"field": "embedding", "vector": VECTOR}}}, {"query": {"binary_dense_vector": {"field": "code", "words": [CODE]}}, "weight": 0.5}], "depth": 100}}
    return every(engine.search("v", spec, 10, reranker={"field": "embedding", "vector": VECTOR, "limit": 50}))

"""An inverted index as tables, for indexes that are searched often.

postings (field, term, doc_id, ordinal, tf, positions, length) lie sorted by term within
buckets of it, so that a term's rows are read by row group. term_stats and field_stats hold what
scores need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import scoring
from quarry.operators.mutations import Versions
from quarry.plans.planner import Index


def postings(index: Index, field: str) -> DataFrame:
    """(term, id, ordinal, tf, positions, length) of every distinct token of every document or chunk."""
    f = index.schema[field]
    units = index.docs.select(index.id_col, index.tokens(field).alias("t"))
    units = units.select(index.id_col, F.posexplode("t").alias("ordinal", "t")) if f.chunked else units.select(index.id_col, F.lit(0).alias("ordinal"), "t")
    each = units.select(index.id_col, "ordinal", F.size(F.array_compact("t")).alias("length"), F.posexplode("t").alias("pos", "term")).filter("term is not null")
    grouped = each.groupBy("term", index.id_col, "ordinal", "length").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return grouped.select("term", index.id_col, "ordinal", "tf", "positions", "length")


def field_stats(index: Index, fields: list[str]) -> DataFrame:
    """(field, n_units, total_tokens, avg_len): one pass over the documents."""
    rows = index.docs.select(*[index.tokens(f).alias(f) for f in fields])
    size = lambda f: F.aggregate(f, F.lit(0), lambda s, x: s + F.size(F.array_compact(x))) if index.schema[f].chunked else F.size(F.array_compact(f))
    units = lambda f: F.size(f) if index.schema[f].chunked else F.when(F.col(f).isNotNull(), 1)
    sums = rows.agg(*[x for f in fields for x in (F.sum(units(f)).alias(f"{f}_n"), F.sum(size(f)).alias(f"{f}_t"))])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_n").alias("n_units"), F.col(f"{f}_t").alias("total_tokens")) for f in fields])
    return sums.select(F.inline(each)).withColumn("avg_len", F.col("total_tokens") / F.nullif("n_units", F.lit(0)))


def build(index: Index, path: str, fields: list[str], buckets: int = 64) -> int:
    """Write postings of the fields as a new version under path: what readers hold stays as it is."""
    spark = index.docs.sparkSession
    union = None
    for f in fields:
        one = postings(index, f).withColumn("field", F.lit(f))
        union = one if union is None else union.unionByName(one)
    sorted_rows = union.repartitionByRange(buckets, "field", "term", index.id_col).sortWithinPartitions("field", "term", index.id_col)
    return Versions(spark, path).commit(sorted_rows)


def search(spark: SparkSession, path: str, field: str, tokens: list[str], stats, id_col: str = "doc_id", k1: float = scoring.K1, b: float = scoring.B) -> DataFrame:
    """(id, score) of any of the tokens from written postings: row groups without them are skipped.

    stats is the field's planner.Stats. A document's tokens are summed where they meet; what is
    shuffled is a row for each posting of the query's tokens.
    """
    rows = Versions(spark, path).read().filter((F.col("field") == field) & F.col("term").isin(tokens))
    weight = F.create_map(*[F.lit(x) for t in dict.fromkeys(tokens) for x in (t, tokens.count(t) * stats.idf(t))])
    score = F.element_at(weight, F.col("term")) * scoring.bm25(F.col("tf"), F.col("length"), 1.0, stats.average, k1, b)
    return rows.groupBy(id_col).agg(F.sum(score).alias("score"))

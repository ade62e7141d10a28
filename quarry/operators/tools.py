"""Data tools: similarity hashes, sorting, term statistics, hash partitions, merging shards' results."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

_C1, _C2, _M32 = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit."""
    h, n = seed, len(data)
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & _M32
    for i in range(0, n - n % 4, 4):
        k = rot(int.from_bytes(data[i : i + 4], "little") * _C1 & _M32, 15) * _C2 & _M32
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & _M32
    if n % 4:
        h ^= rot(int.from_bytes(data[n - n % 4 :], "little") * _C1 & _M32, 15) * _C2 & _M32
    h ^= n
    h = (h ^ (h >> 16)) * 0x85EBCA6B & _M32
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & _M32
    return h ^ (h >> 16)


def simhash(text: str | None) -> int:
    """32 bits: each is set if more words have it clear than set in their hash. 0 without words."""
    words = (text or "").split()
    if not words:
        return 0
    hashes = np.array([murmur3_32(w.encode()) for w in words], np.uint32)
    bits = (hashes[:, None] >> np.arange(32, dtype=np.uint32)) & 1
    clear = len(words) - 2 * bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(clear > 0).astype(np.uint64)).sum())


@F.pandas_udf(T.LongType())
def simhash_udf(texts: pd.Series) -> pd.Series:
    known: dict[str, int] = {}

    def one(text: str | None) -> int:
        words = (text or "").split()
        if not words:
            return 0
        if len(known) > 500_000:
            known.clear()
        hashes = np.array([known[w] if w in known else known.setdefault(w, murmur3_32(w.encode())) for w in words], np.uint32)
        clear = len(words) - 2 * ((hashes[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64)
        return int((np.uint64(1) << np.flatnonzero(clear > 0).astype(np.uint64)).sum())

    return texts.map(one).astype("int64")


def with_simhash(df: DataFrame, field: str, output: str | None = None) -> DataFrame:
    return df.withColumn(output or f"{field}_simhash", simhash_udf(F.col(field).cast("string")))


def sorted_by(df: DataFrame, field: str, numeric: bool = False, reverse: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Rows in order of a field; a missing string counts as empty, a missing number as 0."""
    value = F.coalesce(F.col(field).cast("double"), F.lit(0.0)) if numeric else F.coalesce(F.col(field).cast("string"), F.lit(""))
    return df.orderBy(F.desc(value) if reverse else F.asc(value), *ties)


def term_stats(df: DataFrame, fields: Sequence[str], min_df: int = 1) -> DataFrame:
    """(field, term, df, total_tf, max_tf, idf, upper_bound, avg_doc_len): idf is ln((N - df + 0.5) / (df + 0.5)), which may be negative.

    Terms are lower-case words between white space. A document's words are counted within the
    document, by sorting them, so what is shuffled for a term is a row for each task. upper_bound
    is the score of the greatest tf in a document of no length; avg_doc_len is that of all
    documents, over all fields.
    """
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"\p{IsWhite_Space}+"), lambda t: t != "")
    rows = df.select(*[words(c).alias(c) for c in fields])
    total = rows.agg(F.count("*").alias("n"), F.sum(reduce(lambda a, b: a + b, [F.size(c) for c in fields])).alias("t")).first()
    n, average = total["n"], (total["t"] or 0) / total["n"] if total["n"] else 0.0

    def counted(c: str) -> Column:
        """(term, tf) of a document's words: where a sorted word is the first or the last of its kind tells its number."""
        ends = lambda s: F.filter(F.transform(s, lambda w, i: F.when(~F.coalesce(F.get(s, i + 1) == w, F.lit(False)), F.struct(w.alias("term"), i.alias("at")))), lambda x: x.isNotNull())
        tf = lambda e: F.transform(e, lambda x, i: F.struct(x["term"].alias("term"), (x["at"] - F.coalesce(F.get(e, i - 1)["at"], F.lit(-1))).alias("tf")))
        sorted_once = F.transform(F.array(F.array_sort(F.col(c))), ends)
        return F.transform(sorted_once, tf)[0]

    each = reduce(DataFrame.unionByName, [rows.select(F.lit(c).alias("field"), F.inline(counted(c))) for c in fields])
    out = each.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"), F.max("tf").alias("max_tf")).filter(F.col("df") >= min_df)
    idf = F.ln((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    m = F.col("max_tf").cast("double")
    bound = idf * m * 2.2 / (m + F.lit(1.2 * (1 - 0.75)))
    return out.select("field", "term", "df", "total_tf", "max_tf", idf.alias("idf"), bound.alias("upper_bound"), F.lit(float(average)).alias("avg_doc_len"))


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def partition_of(key: Column, weights: Sequence[int]) -> Column:
    """The partition of a key: its hash modulo the weights' sum, in contiguous slices; weights in lowest terms."""
    if not weights or any(w < 1 for w in weights):
        raise ValueError("weights are positive")
    g = math.gcd(*weights)
    ends = np.cumsum([w // g for w in weights])

    @F.pandas_udf("int")
    def slot(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: -1 if k is None else int(np.searchsorted(ends, fnv1a64(str(k).encode()) % int(ends[-1]), side="right"))).astype("int32")

    return slot(key.cast("string"))


def merged_stats(parts: DataFrame) -> DataFrame:
    """(field, term) statistics of shards as those of the whole: sums, and lengths by weight."""
    return parts.groupBy("field", "term").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("df").alias("df"), (F.sum(F.col("avg_len") * F.col("n_docs")) / F.sum("n_docs")).alias("avg_len")
    )


def merged_hits(parts: Sequence[DataFrame], limit: int, id_col: str = "doc_id") -> DataFrame:
    """Shards' ranked lists as one."""
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), F.asc(id_col)).limit(limit)


def placed(index: str, rules: Sequence[tuple[str, str]], default: str | None = None) -> str | None:
    """Where an index goes: the first rule whose glob it matches."""
    import fnmatch

    return next((where for glob, where in rules if fnmatch.fnmatchcase(index, glob)), default)

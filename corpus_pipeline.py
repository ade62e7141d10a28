"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import langid, minhash, packing, phrases, quality
from quarry.llm.common import cut, importable, table
from quarry.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told; the network learns from four fifths of them."""
    importable(spark)
    return langid.clear(docs, langid.train(docs.filter(langid.fold(F.col("doc_id"), 5) != 0)))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier takes for good ones."""
    importable(spark)
    learn = quality.fold(F.col("doc_id"), 3) != 1
    return quality.good(docs, quality.train(docs.filter(learn), table(spark, sf_dir, "labels").filter(learn)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that shares 80 % of its five-word shingles."""
    importable(spark)
    return minhash.deduplicated(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of passages of 50 words or more that several documents share only the first."""
    importable(spark)
    rest = phrases.cleaned(docs)
    return rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rest


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048, with the token ids."""
    importable(spark)
    return packing.pack(docs, vocabulary(), keep_ids=True)


STAGES = [
    ("language", language),
    ("quality", good),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: The stages learn models and follow links; SQL can't express them. Tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import bpe, chat, images, kdtree, langid, licenses, minhash, packing, phrases, quality
from quarry.llm.common import table


def vocabulary() -> str:
    """Where this machine keeps the vocabulary file; executors have the same file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality.fold(F.col("doc_id"), 3) == 1
    net = quality.train(docs.filter(~held_out), labels.filter(~held_out))
    return quality.rate(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["end"].cast("string"))), " ")
    return seen.select("conv_id", "speaker", "segment", "n_turns", "text", spans.alias("learnt"))


def op3_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("found", lambda x: F.struct(x["coverage"].alias("coverage"), x["matched"].alias("matched"), (-x["first"]).alias("back"), x["license"].alias("license"))))
    told = found.withColumn("best", best).withColumn("covered", F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + x["matched"]))
    return told.select("doc_id", "n_words", F.size("found").alias("n_found"), "covered", F.col("best.license").alias("license"), F.col("best.coverage").alias("coverage"), F.to_json("found").alias("passages"))


def op6_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No table holds pictures: each vector gives one, and every fourth an edited copy of it.
    return images.copies(images.pictures(table(spark, sf_dir, "embeddings")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold(F.col("doc_id"), 5) == 0
    tagger = langid.train(docs.filter(~held_out))
    return langid.identify(docs, tagger).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op10_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_chat": op2_chat,
    "op3_phrases": op3_phrases,
    "op4_packing": op4_packing,
    "op5_licenses": op5_licenses,
    "op6_images": op6_images,
    "op7_minhash": op7_minhash,
    "op8_langid": op8_langid,
    "op9_bpe": op9_bpe,
    "op10_kdtree": op10_kdtree,
}

ORACLES: dict[str, str] = {
    "op2_chat": r"""
        with turns as (
            select conv_id, role, coalesce(text, '') || '<|im_end|>' || chr(10) as body,
                row_number() over (partition by conv_id order by turn, role, text) as nr,
                sum(length(coalesce(text, '')) + length(coalesce(role, '')) + 34) over (partition by conv_id order by turn, role, text rows unbounded preceding)
                    - length(coalesce(text, '')) - length(coalesce(role, '')) - 34 as begin
            from conversations),
        seen as (
            select t.conv_id, p.role as speaker, cast(floor(begin / 32768) as bigint) as segment, nr, body, t.role = p.role as mine,
                '<|im_start|>' || case when t.role is null then 'user' when t.role = 'system' then 'system' when t.role = p.role then 'assistant' else 'user name=' || t.role end || chr(10) as head
            from turns t join (select distinct conv_id, role from conversations where role <> 'system') p using (conv_id)),
        placed as (
            select *, sum(length(head) + length(body)) over (partition by conv_id, speaker, segment order by nr rows unbounded preceding) - length(body) as here
            from seen)
        select conv_id, speaker, segment, count(*) as n_turns, string_agg(head || body, '' order by nr) as text,
            coalesce(string_agg(case when mine then cast(here as bigint) || '-' || cast(here + length(body) - 1 as bigint) end, ' ' order by nr), '') as learnt
        from placed group by conv_id, speaker, segment""",
}

"""Queries of the corpus operators, the data tools and mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.catalog import DIGITS, query, table
from quarry.operators import corpus, mutations, tools

WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"

NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\v]+', ' ', 'g'), '\n ', chr(10), 'g'),
    '\n{4,}', repeat(chr(10), 3), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"""
RECORDS = f"records as (select cast(doc_id as varchar) as record_key, {NORMAL} as text, lang, source from documents where not contains(text, chr(65533)) and length({NORMAL}) >= 1)"
UNIQUE = "uniq as (select r.* from records r join (select text, min(record_key) as k from records group by text) m on r.record_key = m.k)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return corpus.with_normalised(docs.select(F.col("doc_id").cast("string").alias("record_key"), "text", "lang", "source"))


def unique(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    """The first record of each text: its key, the text's SHA-256, and columns made of the record before any is compared."""
    rows = records(spark, sf_dir).select("record_key", F.sha2("text", 256).alias("sha256"), *columns)
    return corpus.deduplicated(rows, digest="sha256")


def n_tokens() -> Column:
    """Words of a record's text."""
    return F.size(F.filter(F.split("text", r"\s+"), lambda t: t != "")).cast("long").alias("n_tokens")


@query("corpus_normalize", f"with {RECORDS} select record_key, md5(text) as digest, length(text) as n from records")
def corpus_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("record_key", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


@query("corpus_dedup", f"with {RECORDS}, {UNIQUE} select record_key, lang, md5(text) as digest from uniq")
def corpus_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(spark, sf_dir, F.col("lang"), F.md5("text").alias("digest")).select("record_key", "lang", "digest")


@query("discovery_merge", """with found as (select source as record_key, n_chars / 100.0 as score, ['u' || doc_id % 7, 'u' || doc_id % 3] as uris, '{"lang":"' || lang || '"}' as metadata, substr(md5(text), 1, 8) as inline_text from documents)
    select f.record_key, max(score)::double as score, string_agg(distinct u, ',' order by u) as uris, min(metadata) as metadata, min(inline_text) as inline_text from found f, unnest(f.uris) t(u) group by f.record_key""")
def discovery_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    uri = lambda n: F.concat(F.lit("u"), (F.col("doc_id") % n).cast("string"))
    found = d.select(F.col("source").alias("record_key"), (F.col("n_chars") / 100.0).alias("score"), F.array(uri(7), uri(3)).alias("uris"), F.concat(F.lit('{"lang":"'), "lang", F.lit('"}')).alias("metadata"), F.substring(F.md5("text"), 1, 8).alias("inline_text"))
    return corpus.merged(found).withColumn("uris", F.array_join("uris", ","))


RULES = (
    corpus.Rule("legal", any=("license", "copyright"), priority=5),
    corpus.Rule("french", metadata=(("lang", "fr"),), none=("license",), priority=1),
    corpus.Rule("thing", any=("thing", "ding"), all=("the",), priority=1),
    corpus.Rule("long", all=("and", "of"), none=("thing",)),
)
_HAS = lambda x: f"contains(lower(text), '{x}')"
CLASS = f"""coalesce((select arg_min(label, (p, m, n, label)) from (values
    (-5, 0, -(({_HAS('license')})::int + ({_HAS('copyright')})::int), 'legal', {_HAS('license')} or {_HAS('copyright')}),
    (-1, -1, -1, 'french', lang = 'fr' and not {_HAS('license')}),
    (-1, 0, -(({_HAS('thing')})::int + ({_HAS('ding')})::int + 1), 'thing', ({_HAS('thing')} or {_HAS('ding')}) and {_HAS('the')}),
    (0, 0, -3, 'long', {_HAS('and')} and {_HAS('of')} and not {_HAS('thing')})) v(p, m, n, label, ok) where ok), 'other')"""


@query("corpus_classify", f"with {RECORDS} select record_key, {CLASS} as topic from records")
def corpus_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("record_key", corpus.classified(F.col("text"), RULES, "other", {"lang": F.col("lang")}).alias("topic"))


@query("corpus_render", f"""with {RECORDS}, {UNIQUE}, c as (select *, case lang when 'en' then 2 when 'de' then 3 else 1 end as n from uniq),
    v as (select record_key, 'base' as view, i::int as copy, text from (select *, unnest(range(n)) as i from c)
        union all select record_key, 'titled', 0, 'Topic: ' || lang || chr(10) || text || chr(10) || '${{unknown}}' from c where n < 3
        union all select record_key, 'sourced', 0, '[' || source || '] ' || text from c where n + 1 < 3)
    select record_key, view, copy, md5(text) as digest from v""".replace("{{", "{").replace("}}", "}"))
def corpus_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unique(spark, sf_dir, F.col("text"), F.col("lang"), F.col("source"))
    n = corpus.copies(1, {"en": 2, "de": 3}, {}, F.col("lang"), F.lit(""))
    templates = [("titled", "Topic: ${topic}\n${text}\n${unknown}"), ("sourced", "[${metadata.source}] ${text}")]
    values = {"topic": F.col("lang"), "text": F.col("text"), "metadata.source": F.col("source")}
    return corpus.views(rows, n, templates, 3, values).select("record_key", "view", "copy", F.md5("text").alias("digest"))


COUNTED = f"{RECORDS}, {UNIQUE}, cnt as (select *, len({WORDS.format('text')}) as n_tokens from uniq), run as (select *, sum(n_tokens) over (order by record_key rows unbounded preceding) - n_tokens as before from cnt)"


@query("corpus_token_budget", f"with {COUNTED} select record_key, n_tokens from run where before < 20000 and before + n_tokens <= 25000")
def corpus_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unique(spark, sf_dir, n_tokens()).select("record_key", "n_tokens")
    return corpus.budgeted(rows, "record_key", "n_tokens", 20000, 25000)


_SHARDS = f"""with recursive {COUNTED}, num as (select record_key, text, n_tokens, row_number() over (order by record_key) as i from cnt),
    s(i, record_key, text, n_tokens, shard, total) as (select i, record_key, text, n_tokens, 0::bigint, n_tokens::bigint from num where i = 1
        union all select n.i, n.record_key, n.text, n.n_tokens, s.shard + (s.total > 0 and s.total + n.n_tokens > 10000)::int, case when s.total > 0 and s.total + n.n_tokens > 10000 then n.n_tokens else s.total + n.n_tokens end from s join num n on n.i = s.i + 1) """


@query("corpus_shards", _SHARDS + "select shard, count(*) as records, sum(n_tokens) as tokens from s group by shard")
def corpus_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unique(spark, sf_dir, n_tokens()).select("record_key", "n_tokens")
    return corpus.sharded(rows, "record_key", "n_tokens", 10000).groupBy("shard").agg(F.count("*").alias("records"), F.sum("n_tokens").alias("tokens"))


@query("corpus_manifest", _SHARDS + "select shard, count(*) as records, sum(n_tokens) as tokens, sha256(string_agg(sha256(text), '' order by record_key)) as sha256 from s group by shard")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unique(spark, sf_dir, n_tokens())
    cut = corpus.sharded(rows, "record_key", "n_tokens", 10000)
    return corpus.manifest(cut, "record_key", "n_tokens", digest="sha256")


@query("curriculum_compose", f"""with {COUNTED},
    s as (select *, case lang when 'en' then 3.0 when 'fr' then 1.0 end as weight, case lang when 'en' then sha256('17:warmup:en') else sha256('17:warmup:fr') end as tie,
        sum(n_tokens) over (partition by lang order by record_key rows unbounded preceding) - n_tokens as own from cnt where lang in ('en', 'fr')),
    t as (select *, sum(n_tokens) over (order by own / weight, tie, record_key rows unbounded preceding) - n_tokens as before2, row_number() over (order by own / weight, tie, record_key) - 1 as position from s)
    select 'warmup' as stage, position, record_key, lang as stratum, n_tokens from t where before2 < 20000""")
def curriculum_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unique(spark, sf_dir, F.col("lang"), n_tokens()).select("record_key", "lang", "n_tokens")
    strata = (corpus.Stratum("en", F.col("lang") == "en", 3.0), corpus.Stratum("fr", F.col("lang") == "fr", 1.0))
    return corpus.compose(rows, [corpus.Stage("warmup", 20000, strata)])


@query("supervised_frames", "select a.conv_id, a.turn, u.text as prompt, a.text as response from conversations a join conversations u on u.conv_id = a.conv_id and u.turn + 1 = a.turn where a.role = 'assistant' and u.role = 'user'")
def supervised_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.framed(table(spark, sf_dir, "conversations"))


# Tools


@query("term_stats", f"""with d as (select doc_id, {WORDS.format('lower(text)')} as t from documents), tf as (select doc_id, x as term, count(*) as tf from (select doc_id, unnest(t) as x from d) group by all),
    n as (select count(*) as n from documents)
    select 'text' as field, term, count(*) as df, sum(tf) as total_tf, max(tf) as max_tf, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf,
        round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) * max(tf) * 2.2 / (max(tf) + 1.2 * 0.25), 6) as upper_bound, round((select sum(tf) from tf) / any_value(n), 6) as avg_doc_len
    from tf, n group by term having count(*) >= 3""")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tools.term_stats(table(spark, sf_dir, "documents"), ["text"], 3)
    return got.select("field", "term", "df", "total_tf", "max_tf", *[F.round(c, DIGITS).alias(c) for c in ("idf", "upper_bound", "avg_doc_len")])


@query("simhash32", None)
def simhash32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.with_simhash(table(spark, sf_dir, "documents"), "text").select("doc_id", "text_simhash")


@query("sort_numeric_desc", "select o_orderkey, o_totalprice from orders order by coalesce(o_totalprice, 0) desc, o_orderkey")
def sort_numeric_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.sorted_by(table(spark, sf_dir, "orders"), "o_totalprice", True, True, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


# FNV-1a: the low byte is xored, then a product modulo 2**64.
_FNV = "list_reduce(list_transform(string_split(cast(o_orderkey as varchar), ''), lambda c: ascii(c)::hugeint), lambda h, c: ((h - h % 256 + xor((h % 256)::int, c::int)) * 1099511628211) % 18446744073709551616, 14695981039346656037::hugeint)"


@query("fnv_partition_counts", f"with h as (select {_FNV} % 4 as h from orders) select (case when h < 1 then 0 when h < 3 then 1 else 2 end)::int as slot, count(*) as n from h group by 1")
def fnv_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(tools.partition_of(F.col("o_orderkey"), [2, 4, 2]).alias("slot"))
    return orders.groupBy("slot").agg(F.count("*").alias("n"))


@query("sharded_stats_merge", f"""with d as (select doc_id % 4 as shard, {WORDS.format('lower(text)')} as t from documents)
    select 'text' as field, 'the' as term, count(*)::bigint as n_docs, count_if(list_contains(t, 'the'))::bigint as df, round(sum(len(t)) / count(*), 6) as avg_len from d""")
def sharded_stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("shard"), t.alias("t"))
    parts = d.groupBy("shard").agg(F.count("*").alias("n_docs"), F.count_if(F.array_contains("t", "the")).alias("df"), F.avg(F.size("t")).alias("avg_len"))
    return tools.merged_stats(parts.select(F.lit("text").alias("field"), F.lit("the").alias("term"), "n_docs", "df", "avg_len")).withColumn("avg_len", F.round("avg_len", DIGITS))


# Mutations: events by user


@query("upsert_latest", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "user_id", "event_id", "ts", "value")
    return mutations.upserted(events.limit(0), events, "key", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("delete_by_key", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return mutations.deleted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("insert_unique", "select user_id::varchar as key, event_id from (select *, row_number() over (partition by user_id order by event_id) as r from events) where r = 1")
def insert_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "event_id")
    return mutations.inserted(new.limit(0), new, "key", "event_id")[0]


@query("content_hash_skip", "select o_orderkey::varchar as key, o_orderstatus as hash, case when o_orderkey % 3 = 0 and o_orderstatus <> 'O' then 'new' else 'old' end as version from orders")
def content_hash_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order comes again with hash O: those that had it stay as they are."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("hash"), F.lit("old").alias("version"), "o_orderkey")
    new = old.filter("o_orderkey % 3 = 0").withColumn("hash", F.lit("O")).withColumn("version", F.lit("new"))
    out = mutations.upserted(old, new, "key", ["o_orderkey"], "hash")
    # The hash that a replaced order had, for the comparison.
    return out.drop("hash").join(old.select("key", "hash"), "key").select("key", "hash", "version")


@query("index_info", "select count_if(user_id % 10 <> 0) as num_docs, count_if(user_id % 10 = 0) as num_deleted, round(count_if(user_id % 10 = 0) / count(*), 6) as deleted_ratio, count_if(user_id % 10 <> 0 and props is not null) as props_docs from events")
def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    got = mutations.index_info(events, events.filter("user_id % 10 = 0").select("event_id"), "event_id", ["props"])
    return got.withColumn("deleted_ratio", F.round("deleted_ratio", DIGITS))


@query("json_documents", "select event_id::varchar as id, (props->>'k')::bigint as k from events where (props->>'k') is not null")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from JSON lines, by a schema."""
    from quarry.schema import parse_schema
    from quarry.sources import jsonl

    lines = table(spark, sf_dir, "events").select(F.concat(F.lit('{"id": "'), F.col("event_id").cast("string"), F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit(', "other": [1]}')).alias("value"))
    schema = parse_schema("index e { field id: text<raw> [indexed, stored, primary] field k: i64 [fast, stored] }")
    return jsonl.parse_documents(lines, schema).filter("error is null").select("id", "k")

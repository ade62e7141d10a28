"""Corpus building: normalise, deduplicate, classify, render, budget, shard, compose."""

from __future__ import annotations

import functools
import hashlib
import json
import operator
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators.written import materialised


def normalised(text: Column, blank_lines: int = 2, least: int = 1) -> Column:
    """Canonical line ends and spaces, trimmed; null where the text is broken or too short.

    Carriage returns become newlines. A run of other white space becomes one space, or nothing
    after a newline. More than ``blank_lines`` blank lines in a row are cut to that many. Patterns
    are looked for only in texts that hold what they begin with.
    """
    lines = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    lines = F.replace(F.regexp_replace(lines, r"[\p{IsWhite_Space}&&[^\n]]+", " "), F.lit("\n "), F.lit("\n"))
    many = "\n" * (blank_lines + 2)
    lines = _bound(lines, lambda x: F.when(F.contains(x, F.lit(many)), F.regexp_replace(x, f"\n{{{blank_lines + 2},}}", many[1:])).otherwise(x))
    whole = F.when(~F.contains(text, F.lit("�")), F.trim(lines, F.lit(" \n")))
    return _bound(whole, lambda x: F.when(F.length(x) >= least, x))


def _bound(column: Column, f: Callable[[Column], Column]) -> Column:
    """f(column), with column computed once however often f's result names it."""
    return F.transform(F.array(column), f)[0]


def with_normalised(records: DataFrame, text: str = "text", blank_lines: int = 2, least: int = 1) -> DataFrame:
    """records with normalised texts, without those that are broken or too short.

    A generator makes the text: no filter or projection above it is moved below, so each text is
    normalised once, however often a plan names it.
    """
    once = F.explode_outer(F.array(normalised(F.col(text), blank_lines, least))).alias(text)
    return records.select(*[once if c == text else c for c in records.columns]).filter(F.col(text).isNotNull())


def deduplicated(records: DataFrame, key: str = "record_key", text: str = "text", digest: str | None = None) -> DataFrame:
    """One record for each text and key: the first by key stays. Null texts count as one text.

    Records are written once with a number each, so that whatever makes them runs once. Keys,
    digests and numbers alone tell which stay, summed up in the tasks before they are shuffled, so
    that a text of any number of copies is no burden; what is written is then joined by number.
    ``digest`` names a column that tells texts apart; records then need no text.
    """
    told = F.coalesce(F.col(digest) if digest else F.sha2(text, 256), F.lit(""))
    written = materialised(records.filter(F.col(key).isNotNull()).withColumns({"__digest": told, "__id": F.monotonically_increasing_id()}), "records")
    by_key = written.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct("__digest", "__id")).alias("x")).select("__key", "x.*")
    first = by_key.groupBy("__digest").agg(F.min(F.struct("__key", "__id")).alias("x")).select(F.col("x.__id").alias("__id"))
    return written.join(first, "__id", "left_semi").select(*records.columns)


def merged(found: DataFrame, key: str = "record_key") -> DataFrame:
    """Discoveries of one key by several searches as one: best score, all uris, least metadata and inline text."""
    uris = F.array_sort(F.array_distinct(F.flatten(F.collect_set("uris"))))
    return found.groupBy(key).agg(F.max("score").alias("score"), uris.alias("uris"), F.min("metadata").alias("metadata"), F.min("inline_text").alias("inline_text"))


@dataclass(frozen=True)
class Rule:
    """A label for records that hold any, all and none of some words, and whose metadata is equal."""

    label: str
    any: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    metadata: tuple[tuple[str, str], ...] = ()
    priority: int = 0


def classified(text: Column, rules: Sequence[Rule], default: str, metadata: Mapping[str, Column] | None = None) -> Column:
    """The label of the best rule that holds: priority, then metadata, then words that count, then the smaller label."""
    if not rules:
        return F.lit(default)
    return _bound(F.lower(text), lambda folded: _best_label(folded, rules, default, metadata or {}))


def _best_label(folded: Column, rules: Sequence[Rule], default: str, metadata: Mapping[str, Column]) -> Column:
    options = []
    for r in rules:
        has = lambda w: F.contains(folded, F.lit(w.lower()))
        tests = [has(w) for w in r.all] + [~has(w) for w in r.none]
        if r.any:
            tests.append(functools.reduce(operator.or_, map(has, r.any)))
        tests += [metadata[k].eqNullSafe(F.lit(v)) for k, v in r.metadata]
        counted = [has(w).cast("int") for w in r.any] + [F.lit(len(r.all) + len(r.none))]
        holds = functools.reduce(operator.and_, tests) if tests else F.lit(True)
        option = F.struct(F.lit(-r.priority).alias("p"), F.lit(-len(r.metadata)).alias("m"), (-functools.reduce(operator.add, counted)).alias("n"), F.lit(r.label).alias("label"))
        options.append(F.when(holds, option))
    return F.coalesce(F.array_min(F.array_compact(F.array(*options)))["label"], F.lit(default))


_SLOT = re.compile(r"\$\{([^}]*)\}")


def rendered(template: str, values: Mapping[str, Column]) -> Column:
    """The template with ${name} filled in, once: what is filled in is not looked at again. Unknown names stay."""
    parts, at = [], 0
    for m in _SLOT.finditer(template):
        if m.group(1) in values:
            parts += [F.lit(template[at : m.start()]), F.coalesce(values[m.group(1)].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def copies(base: int, by_topic: Mapping[str, int], by_difficulty: Mapping[str, int], topic: Column, difficulty: Column) -> Column:
    """How many plain copies a record gets: the most of the base, its topic's and its difficulty's number."""

    def number(table: Mapping[str, int], c: Column) -> Column:
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), c), F.lit(0)) if table else F.lit(0)

    return F.greatest(F.lit(base), number(by_topic, topic), number(by_difficulty, difficulty))


def views(records: DataFrame, n_copies: Column, templates: Sequence[tuple[str, str]], most: int, values: Mapping[str, Column], text: str = "text") -> DataFrame:
    """Each record's copies (view ``base``, copy 0 up), then a view of each template while there is room."""
    first = F.least(n_copies, F.lit(most))
    base = F.transform(F.sequence(F.lit(0), first - 1), lambda i: F.struct(F.lit("base").alias("view"), i.alias("copy"), F.col(text).alias("text")))
    base = F.when(first > 0, base).otherwise(F.array().cast("array<struct<view:string,copy:int,text:string>>"))
    made = [F.when(first + i < most, F.struct(F.lit(name).alias("view"), F.lit(0).alias("copy"), rendered(t, values).alias("text"))) for i, (name, t) in enumerate(templates)]
    every = F.concat(base, F.array_compact(F.array(*made))) if made else base
    return records.withColumn("v", F.explode(every)).select(*[c for c in records.columns if c != text], "v.*")


def running(records: DataFrame, key: str, size: str, name: str = "before") -> DataFrame:
    """records with the sum of size over all smaller keys, by two passes of sums."""
    return running_sums(records, [key], {name: size})


def running_sums(records: DataFrame, keys: Sequence[str], sums: Mapping[str, str], by: str | None = None) -> DataFrame:
    """records with a column for each of sums: what its size adds up to over all smaller keys.

    Rows are dealt by ranges of the keys; a running sum over the ranges' totals gives each its
    start. So no task holds more than its range. The dealt rows are written once, as both
    passes must see the same ranges, which are drawn from samples. With ``by``, a column without
    nulls, the sums of its values are apart; still the rows are dealt and written once.
    """
    groups = [by] if by else []
    keys = groups + list(keys)
    dealt = records.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"__part": F.spark_partition_id(), "__seq": F.monotonically_increasing_id()})
    dealt = materialised(dealt, "running")
    ends = dealt.groupBy(*groups, "__part").agg(*[F.sum(size).alias(f"__{name}") for name, size in sums.items()])
    parts = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__part")  # one row for each task and group
    starts = ends.select(*groups, "__part", *[(F.sum(f"__{name}").over(parts) - F.col(f"__{name}")).alias(f"__{name}") for name in sums])
    rows = Window.partitionBy(*groups, "__part").orderBy("__seq").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumns({name: F.coalesce(F.sum(size).over(rows), F.lit(0)) for name, size in sums.items()})
    joined = within.join(starts, [*groups, "__part"]).withColumns({name: F.col(f"__{name}") + F.col(name) for name in sums})
    return joined.select(*[c for c in records.columns if c not in sums], *sums)


def budgeted(records: DataFrame, key: str, size: str, desired: int, maximum: int) -> DataFrame:
    """The first records by key until their sizes reach desired; the record that would pass maximum ends it too."""
    summed = running(records, key, size)
    return summed.filter((F.col("before") < desired) & (F.col("before") + F.col(size) <= maximum)).drop("before")


def sharded(records: DataFrame, key: str, size: str, maximum: int) -> DataFrame:
    """records with shard: by key, a new one begins before a record that would pass maximum, unless it is empty.

    Where a shard begins depends on all before it, so the cuts are made in order: from the
    written keys and sizes alone, never from texts, by one task that holds a running total only.
    """
    schema = records.select(key, size).withColumn("shard", F.lit(0).cast("long")).schema

    def cut(batches):
        shard, total = 0, 0
        for b in batches:
            out = []
            for n in b[size].tolist():
                if total and total + n > maximum:
                    shard, total = shard + 1, 0
                total += n
                out.append(shard)
            b["shard"] = out
            yield b

    metadata = records.select(key, size).orderBy(key).coalesce(1).mapInPandas(cut, schema)
    return records.join(metadata.select(key, "shard"), key)


def manifest(shards: DataFrame, key: str, size: str, text: str = "text", digest: str | None = None) -> DataFrame:
    """(shard, records, tokens, sha256) of each shard: the digest is of its texts' digests, by key.

    ``digest`` names a column of the texts' SHA-256; shards then need no text.
    """
    each = F.col(digest) if digest else F.sha2(text, 256)
    digests = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), each.alias("d")))), lambda x: x["d"]), "")
    return shards.groupBy("shard").agg(F.count("*").alias("records"), F.sum(size).alias("tokens"), F.sha2(digests, 256).alias("sha256"))


def canonical_sha256(value) -> str:
    """Digest of a JSON value, with sorted keys and without spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@dataclass(frozen=True)
class Stratum:
    name: str
    predicate: Column
    weight: float


@dataclass(frozen=True)
class Stage:
    name: str
    desired: int
    strata: tuple[Stratum, ...]
    minimum: int = 0
    maximum: int | None = None
    predicate: Column | None = None
    unmatched: str = "exclude"  # or "error"
    deviation: float | None = None  # most that a stratum's share may miss its weight's by


def compose(records: DataFrame, stages: Sequence[Stage], key: str = "record_key", size: str = "n_tokens", seed: int = 17) -> DataFrame:
    """(stage, position, record_key, stratum, n_tokens): a curriculum, stage by stage.

    Again and again the stratum with the least emitted tokens for its weight gives its next
    record (ties by a digest of seed, stage and stratum), until the stage has its tokens. The
    choice is sequential, and reads only (stratum, order, key, size). A stratum's i-th record is
    taken when its total before is the least, so that order is a sort by (total before / weight,
    tie), and the stage is a running sum over it. All strata's totals come from one running sum.
    A record's own stratum has no more tokens before it than the stage has, so that one with
    ``desired`` or more in its stratum is never taken, nor anything after it: what is sorted is at
    most ``desired`` tokens of each stratum. As totals only grow, those taken are the first in order.
    """
    out = []
    for stage in stages:
        rows = records if stage.predicate is None else records.filter(stage.predicate)
        tests = [s.predicate.cast("boolean") for s in stage.strata]
        n_hits = functools.reduce(operator.add, [F.coalesce(t, F.lit(False)).cast("int") for t in tests])
        name = F.coalesce(*[F.when(t, F.lit(s.name)) for t, s in zip(tests, stage.strata)])
        wrong = F.when(n_hits > 1, F.raise_error(F.lit(f"strata of stage {stage.name} overlap")).cast("string"))
        if stage.unmatched == "error":
            wrong = wrong.when(n_hits == 0, F.raise_error(F.lit(f"a record of stage {stage.name} is in no stratum")).cast("string"))
        tagged = rows.select(key, size, wrong.otherwise(name).alias("stratum")).filter("stratum is not null")
        tie = F.create_map(*[F.lit(x) for s in stage.strata for x in (s.name, hashlib.sha256(f"{seed}:{stage.name}:{s.name}".encode()).hexdigest())])
        weight = F.create_map(*[F.lit(x) for s in stage.strata for x in (s.name, float(s.weight))])
        streams = running_sums(tagged, [key], {"before": size}, by="stratum").filter(F.col("before") < stage.desired)
        turn = F.struct((F.col("before") / F.element_at(weight, F.col("stratum"))).alias("at"), F.element_at(tie, F.col("stratum")).alias("tie"), F.col(key).alias("k"))
        placed = running_sums(streams.withColumns({"turn": turn, "__one": F.lit(1)}), ["turn"], {"before": size, "position": "__one"})
        kept = placed.filter(F.col("before") < stage.desired)
        if stage.maximum is not None:
            kept = kept.filter(F.col("before") + F.col(size) <= stage.maximum)
        out.append(kept.select(F.lit(stage.name).alias("stage"), "position", key, "stratum", size))
    return functools.reduce(DataFrame.unionByName, out)


def composed_checks(composed: DataFrame, stages: Sequence[Stage], size: str = "n_tokens") -> list[str]:
    """What a composed curriculum misses: too few tokens, or shares too far from the weights."""
    got = {(r["stage"], r["stratum"]): r["n"] for r in composed.groupBy("stage", "stratum").agg(F.sum(size).alias("n")).collect()}  # one row for each stratum
    wrong = []
    for s in stages:
        total = sum(n for (stage, _), n in got.items() if stage == s.name)
        if total < s.minimum:
            wrong.append(f"{s.name}: {total} tokens of at least {s.minimum}")
        weights = sum(x.weight for x in s.strata)
        for x in s.strata:
            share = got.get((s.name, x.name), 0) / total if total else 0.0
            if s.deviation is not None and abs(share - x.weight / weights) > s.deviation:
                wrong.append(f"{s.name}/{x.name}: share {share:.3f}, not {x.weight / weights:.3f}")
    return wrong


def framed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, prompt, response): each assistant turn right after a user turn, as a supervised pair."""
    asked = turns.filter(F.col(role) == "user").select(conv, (F.col(turn) + 1).alias(turn), F.col(text).alias("prompt"))
    return turns.filter(F.col(role) == "assistant").join(asked, [conv, turn]).select(conv, turn, "prompt", F.col(text).alias("response"))


__all__ = [x for x in dir() if not x.startswith("_") and x not in ("annotations", "operator", "pd")]

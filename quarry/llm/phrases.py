"""Removing passages that repeat across documents, with repeated-phrase automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quarry.llm.common import U64, as_bytes, cut, discard, gram_hashes, importable, mix, small_batches, word_hashes, words_of

#: Words of a window, and of the phrases that windows are found by.
WINDOW, PHRASE = 50, 8
#: Characters of the documents that share an automaton; keys sent to all executors if no more than this many.
SHARD, SENT = 2_000_000, 500_000
#: Symbols of a digit, in which an automaton's words are written.
DIGIT = 32


def anchors(hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, fingerprint) of the phrase that each window picks: its least, leftmost one.

    The choice depends on the window's own words alone, so equal windows pick equal phrases.
    """
    grams = gram_hashes(hashes, phrase)
    span = window - phrase + 1
    if len(grams) < span:
        return np.empty(0, np.int64), np.empty(0, U64)
    n, least, width = len(grams), mix(grams), 1
    at = np.arange(n)
    while width < span:  # doubling: the least of the next 2 * width phrases from the least of two runs
        step = min(width, span - width)
        m = len(at) - step
        at = np.where(least[at[:m]] <= least[at[step:]], at[:m], at[step:])
        width += step
    return at, grams[at]


def window_hashes(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window of words, by two rolling polynomials modulo 2**64."""
    n, out = len(hashes), []
    for seed, base in ((0x51ED2701, 0xD1342543DE82EF95), (0x7FEB352D, 0xAF251AF3B0F025B5)):
        h = mix(hashes ^ U64(seed))
        power, total, size = np.array([base], U64), h, 1
        sums = {1: h}
        powers = {1: power}
        while size * 2 <= window:  # sums over runs of 1, 2, 4, ... words
            total = total[:-size] * power + total[size:]
            power = power * power
            size *= 2
            sums[size], powers[size] = total, power
        got, used = np.zeros(n - window + 1, U64), 0
        for size in sorted(sums, reverse=True):
            if window - used >= size:
                got = got * powers[size] + sums[size][used : used + n - window + 1]
                used += size
        out.append(mix(got))
    return out[0], out[1]


def _phrases(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """(phrase, bucket, doc_id) of each document's picked phrases, without repeats in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(2))
            for i in range(0, len(texts), 500):
                said, where = [], []
                for j, text in enumerate(texts[i : i + 500], i):
                    words = words_of(text)
                    at = anchors(word_hashes(words), window, phrase)[0]
                    mine = {b" ".join(words[p : p + phrase]) for p in at[np.r_[True, at[1:] != at[:-1]]].tolist()} if len(at) else ()
                    said += mine
                    where += [j] * len(mine)
                at = pa.array(where, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(said, pa.binary()), b.column(1).take(at), b.column(0).take(at)], ["phrase", "bucket", "doc_id"])

    return rows.select("doc_id", "bucket", "text").mapInArrow(run, "phrase binary, bucket long, doc_id long")


class Locator:
    """An Aho-Corasick automaton that finds every occurrence of phrases of equal length in words.

    The phrases' own words are numbered, and a number is written in digits of DIGIT symbols;
    each place of a digit has symbols of its own, so that a match begins where a word does. A
    word of no phrase is a symbol that matches nothing.
    """

    def __init__(self, phrases: Iterable[bytes], length: int) -> None:
        split = [p.split(b" ") for p in phrases]
        names = list(dict.fromkeys(w for p in split for w in p))
        self.length, self.digits = length, 1
        while DIGIT**self.digits < len(names):
            self.digits += 1
        places = range(self.digits)
        self.code = {w: "".join(chr(1 + k * DIGIT + i // DIGIT**k % DIGIT) for k in places) for i, w in enumerate(names)}
        self.other = chr(1 + self.digits * DIGIT) * self.digits
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in split:
            self.automaton.add_word("".join(map(self.code.__getitem__, p)))
        self.automaton.make_automaton()

    def starts(self, words: list[bytes]) -> np.ndarray:
        """The positions at which a phrase stands among the words."""
        code, other = self.code.get, self.other
        ends = [end for end, _ in self.automaton.iter("".join([code(w, other) for w in words]))]
        return (np.array(ends, np.int64) + 1) // self.digits - self.length


NAMES = ["s1", "s2", "doc_id", "row", "n", "firsts", "hashes"]
KINDS = [pa.int64()] * 4 + [pa.int32(), pa.list_(pa.int32()), pa.binary()]


def segments_of(doc_id: int, row: int, words: list[bytes], starts: np.ndarray, window: int, phrase: int) -> pa.RecordBatch | None:
    """The runs of neighbouring windows of a document that pick one and the same phrase, of those that stand at starts."""
    hashes = word_hashes(words)
    at = anchors(hashes, window, phrase)[0]
    located = np.zeros(len(words), bool)
    located[starts] = True
    firsts = np.flatnonzero(located[at] & np.r_[True, at[1:] != at[:-1]])
    if not len(firsts):
        return None
    h1, h2 = window_hashes(hashes, window)
    lasts = np.r_[np.flatnonzero(at[1:] != at[:-1]), len(at) - 1]
    lasts = lasts[np.searchsorted(lasts, firsts)]
    n = (lasts - firsts + 1).astype(np.int32)
    # The first and the last window overlap, so that they and n tell all words.
    s1, s2 = (mix(mix(h[firsts]) + h[lasts] + n.astype(U64)) for h in (h1, h2))
    order = np.lexsort((firsts, s2, s1))
    s1, s2, n, firsts = s1[order], s2[order], n[order], firsts[order]
    new = np.flatnonzero(np.r_[True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
    both = np.stack([h1, h2], axis=1)
    lists = pa.ListArray.from_arrays(pa.array([*new, len(firsts)], pa.int32()), pa.array(firsts, pa.int32()))
    same = [pa.array(np.full(len(new), x, np.int64)) for x in (doc_id, row)]
    raw = pa.array([both[f : f + m].tobytes() for f, m in zip(firsts[new].tolist(), n[new].tolist())], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(s1[new].view(np.int64)), pa.array(s2[new].view(np.int64)), *same, pa.array(n[new]), lists, raw], names=NAMES)


def _segments(docs: DataFrame, route: DataFrame, window: int, phrase: int) -> DataFrame:
    """(s1, s2, doc_id, row, n, firsts, hashes): neighbouring windows that pick one recurring phrase.

    n windows start at each of firsts; hashes has 128 bits of each of them, s1 and s2 of all
    their words. A bucket has a bounded lot of documents. First come its rows of route: the
    confirmed phrases that are to be looked for there, which are compiled to the bucket's
    automaton, and which of its documents are copies. Then its documents stream through the
    automaton, one at a time; windows are looked at where it finds the phrase that they pick.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, phrases, copies, locator, out, size = None, [], set(), None, [], 0
        for b in batches:
            ids, rows, texts = b.column(2).to_pylist(), b.column(3).to_pylist(), as_bytes(b.column(4))
            for here, is_doc, doc_id, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ids, rows, texts):
                if here != bucket:
                    bucket, phrases, copies, locator = here, [], set(), None
                if not is_doc:
                    copies.add((doc_id, row)) if text is None else phrases.append(text)
                    continue
                if not phrases or (doc_id, row) in copies:
                    continue
                if locator is None:
                    locator = Locator(phrases, phrase)
                words = words_of(text)
                starts = locator.starts(words) if len(words) >= window else ()
                if len(starts) and (found := segments_of(doc_id, row, words, starts, window, phrase)):
                    out.append(found)
                    size += found.nbytes
                    if size > 1 << 22:
                        yield _joined(out)
                        out, size = [], 0
        if out:
            yield _joined(out)

    first = route.select("bucket", F.lit(False).alias("is_doc"), F.col("copy").alias("doc_id"), F.col("copy_row").alias("row"), F.col("phrase").cast("string").alias("text"))
    every = first.unionByName(docs.filter(F.length("text") >= 2 * window - 1).select("bucket", F.lit(True).alias("is_doc"), "doc_id", "row", "text"))
    dealt = every.repartition("bucket").sortWithinPartitions("bucket", "is_doc")
    return dealt.mapInArrow(run, "s1 long, s2 long, doc_id long, row long, n int, firsts array<int>, hashes binary")


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _windows(segments: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, row, pos): the windows of segments; pos: all their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z in range(0, b.num_rows, 1000):
                some = b.slice(z, 1000)
                sizes = some.column(2).to_numpy()
                at = np.repeat(np.arange(len(sizes)), sizes)
                step = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                h = np.frombuffer(b"".join(some.column(4).to_pylist()), np.int64).reshape(-1, 2)
                lists = some.column(3).take(pa.array(at))
                width = np.diff(lists.offsets.to_numpy())
                pos = lists.flatten().to_numpy() + np.repeat(step, width).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(width)].astype(np.int32)), pa.array(pos, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), some.column(0).take(pa.array(at)), some.column(1).take(pa.array(at)), places], ["h1", "h2", "doc_id", "row", "pos"])

    return segments.select("doc_id", "row", "n", "firsts", "hashes").mapInArrow(run, "h1 long, h2 long, doc_id long, row long, pos array<int>")


def repeated_windows(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard: int = SHARD) -> DataFrame:
    """(doc_id, row, spans): where windows start that also start in a smaller doc_id.

    docs: doc_id (not null), row (a hash of the text), text. spans are runs of such starts,
    first and last. It is null for a copy of a whole text of a smaller doc_id: all its windows
    are such.
    """
    total = docs.agg(F.sum(F.length("text")), F.count("*")).first()
    shards = max(1, -(-(total[0] or 0) // shard))
    rows = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)))

    # Whole copies are found by their text's digest; the rest of the work is on one text of each.
    digest = rows.select("doc_id", "row", "bucket", F.md5("text").alias("digest"))
    first = digest.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least")
    copies = cut(digest.join(first, "digest").filter("doc_id > least").select("bucket", F.col("doc_id").alias("copy"), F.col("row").alias("copy_row")), "copies")

    # Phrases that two documents hold, word for word, and the buckets that are to be searched for them.
    with small_batches(docs.sparkSession):
        placed = cut(_phrases(rows, window, phrase).groupBy("phrase", "bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "phrases")
    recurring = placed.groupBy("phrase").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most").select("phrase")
    none = F.lit(None)
    route = placed.select("phrase", "bucket").join(recurring, "phrase", "left_semi").select("bucket", "phrase", none.cast("long").alias("copy"), none.cast("long").alias("copy_row"))
    route = cut(route.unionByName(copies.select("bucket", none.cast("binary").alias("phrase"), "copy", "copy_row")), "route")
    discard(placed)

    # Segments of smaller documents that recur whole; where a segment stands first, its windows are
    # looked at one by one, as each may stand in a smaller document among other words.
    with small_batches(docs.sparkSession):
        found = cut(_segments(rows.select("bucket", "doc_id", "row", "text"), route, window, phrase), "segments")
    discard(route)
    known = found.join(found.groupBy("s1", "s2").agg(F.min("doc_id").alias("least")), ["s1", "s2"])
    whole = cut(known.filter("doc_id > least").select("doc_id", "row", F.flatten(F.transform("firsts", lambda f: F.sequence(f, f + F.col("n") - 1))).alias("pos")), "whole")
    with small_batches(docs.sparkSession, 2000):
        single = cut(_windows(known.filter("doc_id = least")), "windows")
    discard(found)
    least = single.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    repeats = single.join(least, ["h1", "h2"]).filter("doc_id > least").select("doc_id", "row", "pos").unionByName(whole)
    repeats = repeats.groupBy("doc_id", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pos")))).alias("at"))
    runs = lambda edge: F.filter("at", lambda x, i: ~F.coalesce(F.get("at", i + edge) == x + edge, F.lit(False)))
    spans = repeats.select("doc_id", "row", F.arrays_zip(runs(-1).alias("first"), runs(1).alias("last")).alias("spans"))
    kind = spans.schema["spans"].dataType
    out = cut(spans.unionByName(copies.select(F.col("copy").alias("doc_id"), F.col("copy_row").alias("row"), F.lit(None).cast(kind).alias("spans")).distinct()), "repeats")
    for done in (single, whole, copies):
        discard(done)
    return out


def covered(n_words: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Whether each word lies in a window of the spans; a whole copy's (null) words do, if it has a window."""
    if spans is None:
        return np.full(n_words, n_words >= window)
    gone = np.zeros(n_words, bool)
    for span in spans:
        gone[span["first"] : span["last"] + window] = True
    return gone


def _marked(docs: DataFrame, window: int, phrase: int, shard: int, id_col: str, text_col: str, spans: str, hit: str) -> DataFrame:
    """docs with where its repeated windows start, and whether it has any."""
    importable(docs.sparkSession)
    key, row = f"{spans}_key", f"{spans}_row"
    keyed = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(row, F.coalesce(F.xxhash64(text_col), F.lit(0)))
    known = keyed.filter(F.col(key).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key).alias("doc_id"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    repeats = repeated_windows(known, window, phrase, shard)
    n = repeats.agg(F.coalesce(F.sum(F.greatest(F.size("spans"), F.lit(1))), F.lit(0))).first()[0]
    repeats = repeats.select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("spans").alias(spans), F.lit(True).alias(hit))
    return keyed.join(F.broadcast(repeats) if n <= SENT else repeats, [key, row], "left").drop(key, row)


def _kept_words(text: bytes | None, spans: list[dict] | None, hit: bool | None, window: int) -> tuple[list[bytes], list[bytes]]:
    """(all words, those that stay)."""
    words = words_of(text)
    if not hit:
        return words, words
    gone = covered(len(words), spans, window)
    return words, [w for w, g in zip(words, gone.tolist()) if not g]


def cleaned(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all rows and columns, with the words that remove_repeats() removes gone from its texts.

    A text that loses words is its kept words joined by one space (empty if none is left); the
    others stay as they are.
    """
    spans = "_spans"
    while any(c.startswith(spans) for c in docs.columns):
        spans += "_"
    hit = f"{spans}_hit"

    @F.arrow_udf(T.StringType())
    def rest(texts: pa.Array, all_spans: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for text, at, hit in zip(as_bytes(texts), all_spans, hits.to_pylist()):
            words, left = _kept_words(text, at.as_py(), True, window) if hit else ((), ())
            out.append(text if len(words) == len(left) else b" ".join(left))
        return pa.array(out, pa.binary()).cast(pa.string())

    marked = _marked(docs, window, phrase, shard, id_col, text_col, spans, hit)
    return marked.withColumn(text_col, rest(F.col(text_col), F.col(spans), F.col(hit))).select(*docs.columns)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False
) -> DataFrame:
    r"""(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every row.

    Words are ``[^\x20\x09-\x0D]+``, unchanged. Every word is removed that lies in a window of
    ``window`` words which also starts in a document with a smaller id, judged on the input;
    kept words are joined by one space. kept_text (with keep_text) is that text, or the text
    itself, white space and all, where nothing is removed. Null, empty and short texts keep
    what they have: a null text has no words and a null kept_text. A row with a null id neither
    repeats others nor is repeated. Rows that repeat an id are texts of their own, and equal ids
    are not smaller. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    here = _marked(rows, window, phrase, shard, "doc_id", "text", "spans", "hit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, all_spans, hits = as_bytes(b.column(1)), b.column(2), b.column(3).to_pylist()
            for z in range(0, len(texts), 1000):
                n_words, n_removed, digests, kept = [], [], [], []
                for i in range(z, min(z + 1000, len(texts))):
                    words, left = _kept_words(texts[i], all_spans[i].as_py() if hits[i] else None, hits[i], window)
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    joined = b" ".join(left)
                    digests.append(hashlib.sha256(joined).hexdigest())
                    kept.append(joined if len(left) < len(words) else texts[i])
                out = [b.column(0)[z : z + 1000], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary()).cast(pa.string())] * keep_text, names)

    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    names = [x.split()[0] for x in schema.split(", ")]
    return here.select("doc_id", "text", "spans", "hit").mapInArrow(run, schema)

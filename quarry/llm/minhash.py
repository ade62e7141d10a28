"""Near-duplicate documents: MinHash, banding, exact confirmation, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import as_bytes, cut, gram_hashes, importable, mix, small_batches, word_hashes, words_of
from quarry.llm.components import components

#: Minima in a band, and how likely a pair at the threshold may share no band.
ROWS, MISS = 5, 2.5e-7
#: Rows of a block of one bucket; ids, and sketches, that are sent to all executors if no more than this many.
BLOCK, SENT, SKETCHED = 256, 500_000, 100_000


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles, A-Z in lower case.

    A text of fewer words has one shingle, its whole word sequence; one without words has none.
    """
    words = words_of(text.lower() if text else None)
    return np.unique(gram_hashes(word_hashes(words), min(k, len(words)), seed=min(k, len(words)))) if words else np.empty(0, np.uint64)


class Minima:
    """Universal hash minima of sets: multiply and add modulo 2**32, with odd multipliers."""

    def __init__(self, bands: int, rows: int = ROWS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * 2 + 1).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)[:, None]

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 2**32 - 1, np.uint32)
        for i in range(0, len(short), 4096):
            np.minimum(least, (self.a * short[i : i + 4096] + self.b).min(axis=1), out=least)
        return least

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """A 64-bit key of each band, in which the band's number takes part."""
        out = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for part in signature.reshape(self.bands, self.rows).T.astype(np.uint64):
            out = mix(out ^ part)
        return out.view(np.int64)


def linked(common, n_a, n_b, percent: int):
    return 100 * common >= percent * (n_a + n_b - common)


def _signed(rows: DataFrame, k: int, bands: int) -> DataFrame:
    """(doc_id, row, n_shingles, same, bands, sketch); same: a 128-bit hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(bands)
        for b in batches:
            sizes, same, keys, sketches = [], [], [], []
            for text in as_bytes(b.column(2)):
                s = shingle_set(text, k)
                sizes.append(len(s))
                if not len(s):
                    same.append(None), keys.append(None), sketches.append(None)
                    continue
                signature = minima.signature(s)
                same.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(minima.keys(signature))
                sketches.append((signature & 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "row", "n_shingles", "same", "bands", "sketch"],
            )

    return rows.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, n_shingles long, same binary, bands array<long>, sketch binary")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """(rep, set) of rows (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x, k).tobytes() for x in as_bytes(b.column(1))], pa.binary())], ["rep", "set"])

    return rows.mapInArrow(run, "rep long, set binary")


def _few(df: DataFrame, n: int, most: int) -> DataFrame:
    """df, to be sent to all executors if its n rows are no more than most."""
    return F.broadcast(df) if n <= most else df


def _confirmed(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int, bands: int) -> DataFrame:
    """Those of pairs (a, b) that are links: first by signature, then on full sets.

    A pair whose signatures agree 6 standard deviations below the threshold is no link.
    """
    n, t = bands * ROWS, percent / 100
    least = n * (t - 6 * math.sqrt(t * (1 - t) / n))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(b.num_rows, n) for c in b.columns[2:])
                keep = (x == y).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def beside(p: DataFrame, t: DataFrame, c: str) -> DataFrame:
        return p.join(t.toDF("a", f"{c}_a"), "a").join(t.toDF("b", f"{c}_b"), "b").select("a", "b", f"{c}_a", f"{c}_b")

    near = beside(pairs, sketches, "sketch").mapInArrow(alike, "a long, b long")
    return beside(near, sets, "set").mapInArrow(exact, "a long, b long")


def _block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of a block's left rows and those of its other rows.

    The sets of a block are compared all at once, as a product of 0/1 matrices over the
    shingles that occur twice.
    """

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        left = [r for r in rows if r[0]]
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        uses = np.bincount(at)
        column = np.cumsum(uses > 1) - 1
        sizes = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(rows)), sizes)
        keep = uses[at] > 1
        is_left = np.array([bool(r[0]) for r in rows])
        width = int(column[-1]) + 1 if len(column) else 0
        common = np.zeros((len(left), len(rows)), np.float32)
        row, at = row[keep], column[at[keep]]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        for z in range(0, width, 4096):
            i, j = np.searchsorted(at, [z, z + 4096])
            m = np.zeros((len(rows), min(4096, width - z)), np.float32)
            m[row[i:j], at[i:j] - z] = 1
            common += m[is_left] @ m.T
        c, n = common.astype(np.int64), sizes
        ok = linked(c, n[is_left][:, None], n[None, :], percent)
        comp = np.array([r[2] for r in rows], np.int64)
        ok &= comp[is_left][:, None] != comp[None, :]
        mine = comp[is_left]
        return list({(int(mine[i]), int(comp[j])) for i, j in zip(*np.nonzero(ok))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def flush() -> pa.RecordBatch:
            links = compare(rows) if any(r[0] for r in rows) and len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

        for b in batches:
            for *k, left, rep, comp, s in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if rows:
                        yield flush()
                    key, rows = k, []
                rows.append((left, rep, comp, s))
        if rows:
            yield flush()

    order = ["key", "l", "m"]
    return blocks.repartition(*order).sortWithinPartitions(*order).select(*order, "left", "rep", "comp", "set").mapInArrow(run, "a long, b long")


def _told(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, n_shingles, home): home is (doc_id, row) of the first document that links reach, null without one.

    row is a hash of the text. The nodes of all links are classes of equal sets, each with a
    number of its own, so that ids may repeat.
    """
    spark, bands = docs.sparkSession, bands_for(percent)
    importable(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("row"), F.col(text_col).alias("text"))
    with small_batches(spark):
        signed = cut(_signed(rows, k, bands), "signed")
    with_set = signed.filter("doc_id is not null and same is not null")
    classes = with_set.groupBy("same").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.max(F.struct("doc_id", "row")).alias("last"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    # The table that is written fixes the numbers.
    reps = cut(classes.select(F.monotonically_increasing_id().alias("rep"), "same", "first", (F.col("first") != F.col("last")).alias("many"), "bands", "sketch"), "classes")

    # Buckets with more than one class.
    keyed = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).filter("centre < last").drop("last")
    members = cut(keyed.join(shared, "key"), "members")
    wanted = cut(members.select("rep").distinct(), "wanted")
    n_wanted = wanted.count()
    holders = reps.join(_few(wanted, n_wanted, SENT), "rep", "left_semi").select("rep", "first.doc_id", "first.row", "sketch")
    texts = rows.join(_few(holders.drop("sketch"), n_wanted, SENT), ["doc_id", "row"]).select("rep", "text")
    with small_batches(spark):
        sets = cut(_sets(texts, k), "sets")
    if sets.count() > n_wanted:  # a row that stands in the table several times
        sets = cut(sets.dropDuplicates(["rep"]), "sets")

    # Links with each bucket's first class, and their components.
    stars = members.filter("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    with small_batches(spark):  # a set may be as large as a text
        links = cut(_confirmed(stars, sets, _few(holders.select("rep", "sketch"), n_wanted, SKETCHED), percent, bands), "links")
    comp = cut(components(links).toDF("rep", "comp"), "components")
    n_comp = comp.count()

    # Buckets that hold several components. One whose members all share an earlier band is left to that band's.
    placed = members.select("key", "band", "rep").join(_few(comp, n_comp, SENT), "rep", "left").select("key", "band", "rep", F.coalesce("comp", "rep").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
    open_rows = cut(placed.join(split, "key", "left_semi"), "open")
    n_open = open_rows.count()
    merged = components(_between(open_rows, n_open, reps, sets, bands, percent)).toDF("comp", "top") if n_open else None

    linked = reps.select("rep", "same", "first", "many").join(_few(comp, n_comp, SENT), "rep", "left")
    told = linked.select("same", "first", "many", "comp", F.coalesce("comp", "rep").alias("c"))
    if merged is not None:
        told = told.join(_few(merged.toDF("c", "top"), merged.count(), SENT), "c", "left").select("same", "first", "many", F.coalesce("comp", "top").alias("comp"), F.coalesce("top", "c").alias("c"))
    least = told.filter("comp is not null").groupBy("c").agg(F.min("first").alias("least"))
    homes = told.filter("comp is not null or many").join(least, "c", "left").select("same", F.coalesce("least", "first").alias("home"))
    homes = cut(homes, "homes")  # of classes that aren't one document alone
    out = signed.select("doc_id", "row", "n_shingles", "same").join(_few(homes, homes.count(), SENT), "same", "left")
    own = F.when(F.col("doc_id").isNotNull() & F.col("same").isNotNull(), F.struct("doc_id", "row"))
    return out.select("doc_id", "row", "n_shingles", F.when(own.isNotNull(), F.coalesce("home", own)).alias("home"))


def _between(open_rows: DataFrame, n_open: int, reps: DataFrame, sets: DataFrame, bands: int, percent: int) -> DataFrame:
    """Links between the components of buckets that hold several: members outside a bucket's largest are compared with all others, in blocks."""
    with_bands = reps.select("rep", "bands").join(_few(open_rows, n_open, SENT), "rep")
    sums = [f(F.col("bands")[i]).alias(f"{n}{i}") for i in range(bands) for f, n in ((F.min, "x"), (F.max, "y"))]
    earlier = " or ".join(f"(band > {i} and x{i} = y{i})" for i in range(bands))
    buckets = with_bands.groupBy("key").agg(F.min("band").alias("band"), F.count("*").alias("m"), *sums).filter(f"not ({earlier})").select("key", "m")
    largest = open_rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("t"))
    plan = buckets.join(largest, "key").select("key", F.col("t.comp").alias("top"), F.ceil((F.col("m") - F.col("t.c")) / BLOCK).cast("int").alias("nl"), F.ceil(F.col("m") / BLOCK).cast("int").alias("nm"))
    todo = open_rows.join(_few(plan, n_open, SENT), "key").withColumn("left", F.col("comp") != F.col("top"))
    place = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_left = todo.filter("left").select("key", place("nl", 1).alias("l"), each("nm").alias("m"), F.lit(True).alias("left"), "rep", "comp")
    as_other = todo.select("key", each("nl").alias("l"), place("nm", 2).alias("m"), F.lit(False).alias("left"), "rep", "comp")
    blocks = cut(as_left.unionByName(as_other), "blocks").join(sets, "rep")
    with small_batches(sets.sparkSession):
        return cut(_block_links(blocks, percent), "more")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of k-word
    shingles; component_id is the smallest id that links reach. Equal sets are one class before
    anything is compared. Each class goes to one bucket a band; it is compared with its bucket's
    first class, and the components of those links are built. In a bucket that still holds
    several components, the members outside the largest one are compared with all others, in
    blocks of bounded size, so that no link between different texts is lost. What remains is a
    chance of MISS that a pair exactly at the threshold shares no band.

    Texts without words (null, empty, white space) have an empty set, link with nothing and are
    kept. A null id links with nothing, has a null component and is kept. Rows that repeat an id
    count as texts of their own: unlinked ones stay apart, under the same component_id. An empty
    table gives no rows; other columns are not looked at.
    """
    told = _told(docs, k, percent, id_col, text_col)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("home.doc_id", "doc_id"))
    return told.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, of which one stays for each group of near-duplicates.

    The document of the smallest id stays; of several with that id the one whose text's hash is
    least, and of rows that repeat both, one. Rows without an id or without words all stay.
    """
    told = cut(_told(docs, k, percent, id_col, text_col), "told").filter("home is not null")
    names = ["_id", "_row"]
    while set(names) & set(docs.columns):
        names = [f"{x}_" for x in names]
    keyed = docs.withColumn(names[0], F.col(id_col).cast("long")).withColumn(names[1], F.coalesce(F.xxhash64(text_col), F.lit(0)))
    stays = F.struct("doc_id", "row") == F.col("home")
    gone = cut(told.filter(~stays).select("doc_id", "row").distinct().toDF(*names), "gone")
    left = keyed.join(_few(gone, gone.count(), SENT), names, "left_anti")
    again = cut(told.filter(stays).groupBy("doc_id", "row").count().filter("count > 1").select("doc_id", "row").toDF(*names), "again")
    n_again = again.count()
    if not n_again:
        return left.select(*docs.columns)
    one = left.join(_few(again, n_again, SENT), names, "left_semi").dropDuplicates(names)
    return left.join(_few(again, n_again, SENT), names, "left_anti").unionByName(one).select(*docs.columns)

"""Changing an index's documents: inserts, upserts, deletes, and atomic versions of the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Bytes of a primary key, and keys of one delete.
LONGEST_KEY, MOST_DELETES = 65_536, 100_000


def valid_key(key: str):
    return F.col(key).isNotNull() & (F.octet_length(key) >= 1) & (F.octet_length(key) <= LONGEST_KEY)


def latest(ops: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """The last row of each key. A task keeps one row a key before anything is shuffled."""
    rest = [c for c in ops.columns if c != key]
    return ops.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("r")).select(key, "r.*").select(*ops.columns)


def inserted(existing: DataFrame, new: DataFrame, key: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): a key that exists, or came before (by seq), or isn't valid, is rejected."""
    good = new.filter(valid_key(key))
    first = good.groupBy(key).agg(F.min(seq).alias("__first"))
    tagged = good.join(first, key).withColumn("__taken", F.col(seq) > F.col("__first")).drop("__first")
    there = existing.select(key, F.lit(True).alias("__there"))
    tagged = tagged.join(there, key, "left").withColumn("__taken", F.col("__taken") | F.coalesce("__there", F.lit(False)))
    accepted = tagged.filter(~F.col("__taken")).select(*new.columns)
    rejected = tagged.filter("__taken").select(*new.columns, F.lit("duplicate key").alias("error"))
    bad = new.filter(~F.coalesce(valid_key(key), F.lit(False))).select("*", F.lit("invalid key").alias("error"))
    return existing.unionByName(accepted.select(*existing.columns)), rejected.unionByName(bad)


def deleted(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The documents without those of the keys; keys that aren't there do nothing."""
    return existing.join(keys.select(key).distinct(), key, "left_anti")


def upserted(existing: DataFrame, new: DataFrame, key: str, seq: list[str], content_hash: str | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """The documents after whole-document replacement; the last row of a key counts.

    With content_hash, an upsert whose hash is not null and equals the document's changes
    nothing, unless the key is deleted in the same commit (deletes: keys).
    """
    last = latest(new.filter(valid_key(key)), key, seq)
    base = existing if deletes is None else deleted(existing, deletes, key)
    if content_hash:
        same = base.select(key, F.col(content_hash).alias("__hash"))
        last = last.join(same, key, "left").filter(~F.coalesce(F.col(content_hash) == F.col("__hash"), F.lit(False))).drop("__hash")
    return base.join(last.select(key), key, "left_anti").unionByName(last.select(*base.columns))


class Versions:
    """Numbered versions of a table in a folder, with a pointer file that names the current one.

    A commit writes a version whole and then creates its pointer; the highest pointer counts. So
    readers see all of a commit or nothing, and a reader that holds a version keeps it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/current")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def current(self) -> int | None:
        return max(self.numbers(), default=None)

    def read(self, number: int | None = None) -> DataFrame:
        n = self.current() if number is None else number
        if n is None:
            raise FileNotFoundError(f"{self.path} has no version")
        with_name = self._fs.open(self._path(f"{self.path}/current/{n}"))
        name = with_name.readUTF()
        with_name.close()
        return self.spark.read.parquet(f"{self.path}/{name}")

    def commit(self, df: DataFrame, partitions: int | None = None) -> int:
        """Publish df as the next version; a commit that lost a race fails."""
        n = (self.current() if self.current() is not None else -1) + 1
        name = f"v{n}-{uuid.uuid4().hex}"
        (df.repartition(partitions) if partitions else df).write.parquet(f"{self.path}/{name}")
        out = self._fs.create(self._path(f"{self.path}/current/{n}"), False)  # fails if it is there
        out.writeUTF(name)
        out.close()
        return n

    def compact(self, partitions: int) -> int:
        """The current rows again, in so many files."""
        return self.commit(self.read(), partitions)


def index_info(docs: DataFrame, deletes: DataFrame, key: str, text_fields: list[str]) -> DataFrame:
    """One row: documents, deleted ones and their share, and how many hold each text field."""
    marked = docs.join(deletes.select(key, F.lit(True).alias("__gone")).distinct(), key, "left")
    gone = F.count_if(F.col("__gone"))
    return marked.agg(
        F.count_if(F.col("__gone").isNull()).alias("num_docs"), gone.alias("num_deleted"), (gone / F.nullif(F.count("*"), F.lit(0))).alias("deleted_ratio"),
        *[F.count(F.when(F.col("__gone").isNull(), F.col(f))).alias(f"{f}_docs") for f in text_fields],
    )


__all__ = ["Versions", "Window", "deleted", "index_info", "inserted", "latest", "upserted", "valid_key"]

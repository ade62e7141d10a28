"""Shared pieces: words, hashes, cutting lineage, reading tables."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Rows of an Arrow batch of texts.
BATCH, _BATCH_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package from where the driver has it.

    Elsewhere it is installed, or shipped with --py-files. A worker is one task's: its
    linear algebra runs on one thread, unless the environment says otherwise. Rows hold whole
    texts: Arrow batches have BATCH rows, unless the session says otherwise.
    """
    if spark.conf.get(_BATCH_KEY, None) in (None, "10000"):  # the default
        spark.conf.set(_BATCH_KEY, str(BATCH))
    top, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        env.setdefault(name, os.environ.get(name, "1"))
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([top, *filter(None, [env.get("PYTHONPATH")])])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where that setting is missing, a temporary one is made if all run on this machine (a local
    master); elsewhere that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quarry-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is the cluster's to clear then
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The result has no lineage: a lost executor never makes earlier stages run again. The
    shuffle files of those stages are released. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    gc.collect()
    spark._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that cut() made and nothing reads any more."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _remove(df.sparkSession, path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Arrow batches of few rows in jobs that run inside: for rows that hold large values."""
    old = spark.conf.get(_BATCH_KEY, None)
    spark.conf.set(_BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_KEY) if old is None else spark.conf.set(_BATCH_KEY, old)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+``: bytes.split() splits at exactly these six bytes."""
    return text.split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def gram_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of every run of k words (none if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, U64(0x9E3779B97F4A7C15 ^ seed))
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * U64(0xD6E8FEB86659FD93)
        out ^= out >> U64(32)
    return mix(out)


def natural_batches(column_bytes: list[bytes | None], limit: int):
    """Index ranges of at most limit bytes (one text at least)."""
    start = total = 0
    for i, x in enumerate(column_bytes):
        total += len(x or b"")
        if total > limit and i > start:
            yield start, i
            start, total = i, len(x or b"")
    if start < len(column_bytes):
        yield start, len(column_bytes)

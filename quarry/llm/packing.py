"""Packing token ids into fixed-length training sequences by concatenating and cutting."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bpe import LEAF, encoder
from quarry.llm.common import as_bytes, cut, importable

#: Tokens of a sequence.
LENGTH = 2048
SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, path: str, end_id: int | None, id_col: str, text_col: str, leaf: int = LEAF) -> DataFrame:
    """A written table (part, doc_id, before, n, ids): a task's documents in its order.

    before counts the tokens of the same task's earlier documents. It is written once, so that
    both passes of the prefix sum see one order even if tasks run again.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, before = encoder(path, leaf), 0
        small = len(e.tokens) <= 1 << 16 and (end_id or 0) < 1 << 16
        for b in batches:
            texts = as_bytes(b.column(2))
            for i in range(0, len(texts), 512):
                ids = [e.encode(x) + end for x in texts[i : i + 512]]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = before + np.concatenate([[0], np.cumsum(n)])
                before = int(starts[-1])
                if small:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i : i + 512], b.column(1)[i : i + 512], pa.array(starts[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["part", "doc_id", "before", "n", "ids"],
                )

    return cut(rows.mapInArrow(run, f"part int, doc_id {id_type}, before long, n long, ids binary"), "pack-tokens")


def pack(
    docs: DataFrame, path: str, length: int = LENGTH, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows.

    The documents are laid end to end and cut every ``length`` tokens; only the last sequence
    can be short. Pass one sums tokens by task, and a running sum over those few totals gives
    each task its place; pass two adds the place within the task and cuts. A piece is a boundary
    record: where it starts in its document and where it lies in which sequence. With keep_ids,
    a column ids holds its tokens (little-endian, 16 bits if the vocabulary fits, else 32).
    Null texts count as empty: their document is end_id alone (without an end_id they have no
    piece). Rows with the same id are documents of their own. Other columns are not looked at.
    """
    spark = docs.sparkSession
    tokens = tokenised(docs, path, end_id, id_col, text_col)
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row for each task
    places, at = [], 0
    for part, n in totals:
        places.append((part, at))
        at += n
    base = spark.createDataFrame(places, "part int, base long")
    placed = tokens.join(F.broadcast(base) if len(places) <= 100_000 else base, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            firsts, ns = np.add(col["base"].to_numpy(), col["before"].to_numpy()), col["n"].to_numpy()
            where, starts, lengths, crcs, ids = [], [], [], [], []
            for i, (g, n, raw) in enumerate(zip(firsts.tolist(), ns.tolist(), as_bytes(col["ids"]))):
                width = len(raw) // n if n else 4
                arr = np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")
                a = 0
                while a < n:
                    z = min(n, a + length - (g + a) % length)
                    where.append(i)
                    starts.append(a)
                    lengths.append(z - a)
                    crcs.append(zlib.crc32(arr[a:z].tobytes()))
                    if keep_ids:
                        ids.append(raw[a * width : z * width])
                    a = z
            at = np.array(where, np.int64)
            begin = firsts[at] + np.array(starts, np.int64)
            out = [col["doc_id"].take(pa.array(at)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array(ns[at], pa.int64()), pa.array(begin // length), pa.array(begin % length)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * keep_ids, names)

    schema = SCHEMA.format(id_type) + ", ids binary" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return placed.mapInArrow(run, schema)
